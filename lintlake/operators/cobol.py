"""COBOL sources: logical lines by gaps and islands, and governance rules over them. Copybooks (.cpy) are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of fields that hold credentials, and names of copybooks shared by many programs.
CREDENTIAL_FIELD = r"(?i)(PASSWORD|PASSWD|PWD|SECRET|API-?KEY|TOKEN|CREDENTIAL|PIN-CODE)"
SHARED = ["COMMON", "UTILS", "SHARED", "CUSTOMER", "ACCOUNT"]


def logical_lines(files: DataFrame) -> DataFrame:
    """(path, line, text): comments left out, continuations joined to the line they continue, columns 7 to 72 of fixed format."""
    rows = files.where(~F.lower("path").endswith(".cpy")).select("path", F.split("content", "\n").alias("all"))
    fixed = F.exists(F.slice("all", 1, 20), lambda x: x.rlike(r"^[0-9 ]{6}[*/\- ]\s*\S"))
    rows = rows.select("path", fixed.alias("fixed"), F.posexplode("all").alias("pos", "raw"))
    mark = F.substring("raw", 7, 1)
    body = F.when(F.col("fixed"), F.rtrim(F.expr("substring(raw, 8, 65)"))).otherwise(F.regexp_replace("raw", r"\*>.*$", ""))
    kept = rows.where(~(F.col("fixed") & mark.isin("*", "/")) & ~(~F.col("fixed") & F.col("raw").rlike(r"^\s*\*")) & F.col("raw").rlike(r"\S"))
    joined = F.col("fixed") & (mark == "-")
    kept = kept.select("path", "pos", body.alias("text"), joined.alias("more"))
    kept = kept.withColumn("island", F.sum((~F.col("more")).cast("int")).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    parts = kept.groupBy("path", "island").agg((F.min("pos") + 1).alias("line"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return parts.select("path", "line", F.array_join(F.transform("p", lambda x: F.trim(x.text)), " ").alias("text"))


def findings(rows: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity, confidence) of the rules over logical lines."""
    t = F.upper("text")
    f = lambda test, rule_id, severity, confidence: F.when(test, F.struct(F.lit(rule_id).alias("rule_id"), severity.alias("severity") if not isinstance(severity, str) else F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    copybook = F.regexp_extract(t, r"\bCOPY\s+['\"]?([A-Z0-9\-]+)", 1)
    shared = F.lit(False)
    for name in SHARED:
        shared = shared | copybook.contains(name)
    rules = [
        f(t.rlike(r"\bMOVE\s+['\"][^'\"]+['\"]\s+TO\s+\S*" + CREDENTIAL_FIELD[4:]), "COB002", "CRITICAL", 0.90),
        f(t.rlike(r"\bACCEPT\s+\S+") & ~t.rlike(r"\bFROM\s+(DATE|TIME|DAY)"), "COB003", "MEDIUM", 0.80),
        f(t.rlike(r"\bREDEFINES\b"), "COB004", "HIGH", 0.85),
        f(t.rlike(r"\bOCCURS\b.*\bDEPENDING\s+ON\b"), "COB005", "MEDIUM", 0.90),
        f(copybook != "", "COB007", F.when(shared, "CRITICAL").otherwise("HIGH"), 0.60),
    ]
    single = rows.select("path", "line", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("path", "line", "f.*")
    jumps = rows.where(t.rlike(r"\bGO\s+TO\b")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).where("n > 10")
    many = jumps.select("path", "line", F.lit("COB001").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit(0.95).alias("confidence"))
    return single.unionByName(many).unionByName(perform_ranges(rows))


def perform_ranges(rows: DataFrame) -> DataFrame:
    """PERFORM A THRU B over more than five paragraphs, or over one that is not known."""
    t = F.upper("text")
    paragraph = F.regexp_extract(t, r"^\s*([A-Z0-9][A-Z0-9\-]*)\s*\.\s*$", 1)
    places = rows.where(paragraph != "").select("path", paragraph.alias("paragraph"), "line").withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    places = places.groupBy("path", "paragraph").agg(F.min("ordinal").alias("ordinal"))
    calls = rows.where(t.rlike(r"\bPERFORM\s+\S+\s+THRU\s+\S+")).select("path", "line", F.regexp_extract(t, r"\bPERFORM\s+([A-Z0-9\-]+)\s+THRU\s+([A-Z0-9\-]+)", 1).alias("a"), F.regexp_extract(t, r"\bPERFORM\s+([A-Z0-9\-]+)\s+THRU\s+([A-Z0-9\-]+)", 2).alias("b"))
    x, y = places.select("path", F.col("paragraph").alias("a"), F.col("ordinal").alias("i")), places.select("path", F.col("paragraph").alias("b"), F.col("ordinal").alias("j"))
    found = calls.join(x, ["path", "a"], "left").join(y, ["path", "b"], "left")
    known = F.col("i").isNotNull() & F.col("j").isNotNull()
    return found.where(~known | (F.col("j") - F.col("i") + 1 > 5)).select("path", "line", F.lit("COB006").alias("rule_id"), F.lit("HIGH").alias("severity"), F.when(known, 0.70).otherwise(0.60).alias("confidence"))


def blast_radius(rows: DataFrame) -> DataFrame:
    """Programs per copybook."""
    copybook = F.regexp_extract(F.upper("text"), r"\bCOPY\s+['\"]?([A-Z0-9\-]+)", 1)
    return rows.where(copybook != "").groupBy(copybook.alias("copybook")).agg(F.count_distinct("path").alias("programs"))
