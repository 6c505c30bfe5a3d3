"""Queries of the comparing operators over relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.operators import drift, findings, similarity
from lintlake.session import table


def _rules(df: DataFrame, side: int) -> DataFrame:
    """Parts as rule tuples; the sides differ by a few columns."""
    return df.select(
        F.col("p_brand").alias("logical_id"), F.when(F.col("p_size") % 7 == 0, "all").otherwise("TCP").alias("proto"), (F.col("p_size") * 100 + F.when(F.col("p_partkey") % 97 == 0, side).otherwise(0)).cast("string").alias("from_port"),
        (F.col("p_size") * 100).cast("string").alias("to_port"), F.when(F.col("p_partkey") % 5 == 0, "0.0.0.0/0").alias("cidr4"), F.lit(None).cast("string").alias("cidr6"), F.lit(None).cast("string").alias("src_sg"),
    )


def rule_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set differences both ways of two sides of rule tuples."""
    part = table(spark, sf_dir, "part")
    return drift.rule_drift(drift.normal_rules(_rules(part, 0)), drift.normal_rules(_rules(part, 1)))


def drift_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("logical_id"), F.col("l_suppkey").alias("physical_id")).distinct()
    there = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("physical_id"))
    return drift.not_found(mapping, there).groupBy("physical_id").agg(F.count(F.lit(1)).alias("n"))


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three strategies that knows an order's customer: by closed orders, by open ones, by all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("logical_id"), F.col("o_custkey").alias("physical_id"), "o_orderstatus")
    return drift.resolve(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'").withColumn("physical_id", F.col("physical_id") + 1), orders)


def undeclared_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of line items that neither of two lists declares."""
    used = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), "s_acctbal")
    return drift.undeclared(used, s.where("s_acctbal > 5000"), s.where("s_acctbal < 1000"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are expected to have more than one return flag."""
    from lintlake.operators.python_code import contradictions as found

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("function_called"), F.lit("").alias("arguments"), F.col("l_returnflag").alias("expected"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("path"), F.col("l_linenumber").alias("line"), F.lit("t").alias("test_function")
    )
    return found(rows).drop("arguments")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the first hour-long scope of their user that holds them."""
    e = table(spark, sf_dir, "events")
    minute = (F.unix_timestamp("ts") / 60).cast("bigint")
    rows = e.select(F.col("user_id").alias("path"), minute.alias("line"), "event_id")
    starts = e.where("event_type = 'signup'").select(F.col("user_id").alias("path"), minute.alias("start_line"), (minute + 60).alias("end_line"), F.col("event_id").alias("scope")).groupBy("path", "start_line", "end_line").agg(F.min("scope").alias("scope"))
    return findings.in_scopes(rows, starts)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar letter counts among the 200 longest documents; the longest texts are the feature."""
    d = similarity.longest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")))
    counts = F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return similarity.near_duplicates(d.select("id", counts.alias("embedding")), 0.995).withColumn("similarity", F.round("similarity", 6))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with near duplicates among all documents; `near_duplicates` and its SQL look at the 200 longest."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.similar_texts(d).withColumn("similarity", F.round("similarity", 6))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every hundredth, against all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.neighbours(v).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.longest(d).select("id", F.length("text").alias("chars"))


def running_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running position within an order, as a diff keeps in a hunk."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).over(w).alias("position"))


QUERIES = {
    "rule_drift": rule_drift,
    "drift_not_found": drift_not_found,
    "resolve_names": resolve_names,
    "undeclared_suppliers": undeclared_suppliers,
    "contradictions": contradictions,
    "scopes": scopes,
    "near_duplicates": near_duplicates,
    "similar_documents": similar_documents,
    "nearest": nearest,
    "longest_documents": longest_documents,
    "running_cursor": running_cursor,
}


def _rules_sql(side: int) -> str:
    all_ = "p_size % 7 = 0"
    return f"""SELECT p_brand AS logical_id, CASE WHEN {all_} THEN '-1' ELSE 'tcp' END AS proto, CAST(CASE WHEN {all_} THEN -1 ELSE p_size * 100 + CASE WHEN p_partkey % 97 = 0 THEN {side} ELSE 0 END END AS INTEGER) AS from_port,
      CAST(CASE WHEN {all_} THEN -1 ELSE p_size * 100 END AS INTEGER) AS to_port, CASE WHEN p_partkey % 5 = 0 THEN '0.0.0.0/0' END AS cidr4, CAST(NULL AS VARCHAR) AS cidr6, CAST(NULL AS VARCHAR) AS src_sg FROM part"""


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
SQL = {
    "rule_drift": f"""SELECT *, 'MISSING' AS drift, 'HIGH' AS severity FROM ({_rules_sql(0)} EXCEPT {_rules_sql(1)}) UNION ALL
      SELECT *, 'UNEXPECTED' AS drift, CASE WHEN cidr4 = '0.0.0.0/0' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM ({_rules_sql(1)} EXCEPT {_rules_sql(0)})""",
    "drift_not_found": "SELECT l_suppkey AS physical_id, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    "resolve_names": "SELECT o_orderkey AS logical_id, CASE o_orderstatus WHEN 'O' THEN o_custkey + 1 ELSE o_custkey END AS physical_id FROM orders",
    "undeclared_suppliers": "SELECT DISTINCT l_suppkey AS name FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 OR s_acctbal < 1000)",
    "contradictions": """WITH f AS (SELECT CAST(l_partkey AS VARCHAR) AS p, l_returnflag AS e, min(lpad(CAST(l_orderkey AS VARCHAR), 12, '0')) AS o FROM lineitem GROUP BY 1, 2),
      w AS (SELECT p, e, o, first_value(e) OVER c AS e1, first_value(o) OVER c AS o1 FROM f WINDOW c AS (PARTITION BY p ORDER BY e))
      SELECT p AS function_called, e1 AS expected_1, e AS expected_2, o1 AS path_1, o AS path_2 FROM w WHERE e <> e1""",
    "scopes": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM events), s AS (SELECT user_id, m, min(event_id) AS scope FROM e WHERE event_type = 'signup' GROUP BY 1, 2)
      SELECT e.user_id AS path, e.m AS line, e.event_id, min_by(s.scope, s.m) AS scope FROM e JOIN s ON e.user_id = s.user_id AND e.m BETWEEN s.m AND s.m + 60 GROUP BY 1, 2, 3""",
    "near_duplicates": f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents ORDER BY length(lower(text)) DESC, doc_id LIMIT 200),
      v AS (SELECT doc_id, [{", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in LETTERS)}] AS embedding FROM d),
      p AS (SELECT a.doc_id AS id_1, b.doc_id AS id_2, {_COSINE} AS s FROM v a JOIN v b ON a.doc_id < b.doc_id)
      SELECT id_1, id_2, round(s, 6) AS similarity, CASE WHEN s >= 0.95 THEN 'HIGH' WHEN s >= 0.90 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM p WHERE s >= 0.995""",
    "nearest": f"""SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) <= 5""",
    "longest_documents": "SELECT doc_id AS id, CAST(length(text) AS INTEGER) AS chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 200",
    "running_cursor": "SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM lineitem",
}
