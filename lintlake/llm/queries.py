"""Queries of the subpackage, by name; every callable takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of findings with the accepted finding each repeats."""
    from lintlake.llm.incremental_dedup import repeats

    return repeats(table(spark, sf_dir, "analysis_issues"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content a parser of their language rejects."""
    from lintlake.llm.syntax import unparsable

    return unparsable(table(spark, sf_dir, "source_files")).select("file_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files do not parse, per repository and language."""
    from lintlake.llm.syntax import rates

    return rates(table(spark, sf_dir, "source_files"))


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintlake.llm.percentiles import canonical_command, canonical_version

    return table(spark, sf_dir, "telemetry_events").select(
        canonical_command("command").alias("command"), canonical_version("version").alias("version"), F.to_date("ts").alias("day"), "duration_ms"
    )


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of durations per command and version, day by day and over all days by combining the days."""
    from lintlake.llm.percentiles import combine, from_counts, value_counts

    keys = ["command", "version"]
    daily = value_counts(_timed_events(spark, sf_dir), [*keys, "day"], "duration_ms")
    total = combine([daily.drop("day")], keys).withColumn("day", F.lit(None).cast("date"))
    levels = daily.withColumn("level", F.lit("day")).unionByName(total.withColumn("level", F.lit("all")))
    return from_counts(levels, ["level", *keys, "day"]).withColumn("estimate", F.round("estimate", 4))


def p3_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinable form, day by day: how often each duration occurs."""
    from lintlake.llm.percentiles import value_counts

    return value_counts(_timed_events(spark, sf_dir), ["command", "version", "day"], "duration_ms")


_TIMED_SQL = r"""
SELECT nullif(regexp_replace(lower(trim(command)), '[_\s]+', '-', 'g'), '') AS command,
       nullif(regexp_extract(version, '(\d+(?:\.\d+)*)', 1), '') AS version, CAST(ts AS DATE) AS day, duration_ms
FROM telemetry_events WHERE duration_ms IS NOT NULL"""
_POINTS_SQL = "[0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]::DOUBLE[]"


def _percentile_sql(level: str, day: str, group: str) -> str:
    return f"""
SELECT '{level}' AS level, command, version, {day} AS day, count(*) AS n_values, min(duration_ms) AS min_value, max(duration_ms) AS max_value,
       unnest({_POINTS_SQL}) AS percentile, round(unnest(quantile_cont(duration_ms, {_POINTS_SQL})), 4) AS estimate, CAST(0 AS DOUBLE) AS error_bound
FROM e GROUP BY {group}"""


def _credential_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "analysis_issues").select(
        F.lit("analysis_issues").alias("src_table"), F.col("issue_id").alias("record_id"), F.col("code_snippet").alias("body")
    )
    cloud = table(spark, sf_dir, "cloud_findings").select(
        F.lit("cloud_findings").alias("src_table"), F.col("finding_id").alias("record_id"), F.col("evidence").alias("body")
    )
    return issues.unionByName(cloud)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every credential in code snippets and evidence begins."""
    from lintlake.llm.credentials import credentials

    return credentials(_credential_texts(spark, sf_dir), ["src_table", "record_id"], "body").select("src_table", "record_id", "start_pos")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential's place and the text without its credentials."""
    from lintlake.llm.credentials import credentials

    return credentials(_credential_texts(spark, sf_dir), ["src_table", "record_id"], "body", with_text=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no team member wrote by hand."""
    from lintlake.llm.handwritten import not_handwritten

    return not_handwritten(table(spark, sf_dir, "source_files")).select("file_id")


def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no team member wrote by hand, with the reasons."""
    from lintlake.llm.handwritten import not_handwritten

    return not_handwritten(table(spark, sf_dir, "source_files")).select("file_id", F.concat_ws(", ", F.array_sort("reasons")).alias("reasons"))


def p7_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each kind of evidence settles: notices, paths, measures of the text, copies."""
    from lintlake.llm.handwritten import not_handwritten

    found = not_handwritten(table(spark, sf_dir, "source_files")).select(F.explode(F.arrays_zip("reasons", "evidence")).alias("r"))
    return found.groupBy(F.col("r.reasons").alias("reason"), F.col("r.evidence").alias("evidence")).agg(F.count(F.lit(1)).alias("files"))


def _sized(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    from lintlake.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), keys)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container of 2,048 tokens."""
    from lintlake.llm.packing import containers

    return containers(_sized(spark, sf_dir, ["doc_id"]))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are and how much of them is unused."""
    from lintlake.llm.packing import containers, report

    return report(containers(_sized(spark, sf_dir, ["doc_id"])))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, documents placed, and whether no container is too full, no document split without need and no token lost."""
    from lintlake.llm.packing import CAPACITY, containers
    from lintlake.session import stored

    sized = stored(_sized(spark, sf_dir, ["doc_id"]), "sized")
    packed = stored(containers(sized), "packed")
    fullest = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("held")).agg((F.max("held") <= CAPACITY).alias("within_capacity"))
    parts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("placed"))
    whole = sized.join(parts, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count("parts").alias("documents_placed"), F.bool_and(F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))).alias("split_if_needed"), F.bool_and(F.col("placed") == F.col("n_tokens")).alias("tokens_kept")
    )
    return whole.join(fullest, F.lit(True))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its target, and whether it is reached to a thousandth without repeats beyond the limit."""
    from lintlake.llm.mixing import mix, shares

    got = shares(*mix(_sized(spark, sf_dir, ["doc_id", "source"]), table(spark, sf_dir, "mix_targets")))
    return got.select("source", "target_share", (F.abs(F.col("reached_share") - F.col("target_share")) < 0.001).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    from lintlake.llm.mixing import mix

    return mix(_sized(spark, sf_dir, ["doc_id", "source"]), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens each source reaches beside its target."""
    from lintlake.llm.mixing import mix, shares

    return shares(*mix(_sized(spark, sf_dir, ["doc_id", "source"]), table(spark, sf_dir, "mix_targets")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no real text or text a template left unfinished."""
    from lintlake.llm.residue import residue

    return residue(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p3_percentiles": p3_percentiles,
    "p3_daily_counts": p3_daily_counts,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_reasons": p7_reasons,
    "p7_evidence": p7_evidence,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_invariants": p8_invariants,
    "p9_invariants": p9_invariants,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

SQL: dict[str, str] = {
    "p3_percentiles": f"WITH e AS ({_TIMED_SQL}) {_percentile_sql('day', 'day', 'command, version, day')} UNION ALL {_percentile_sql('all', 'CAST(NULL AS DATE)', 'command, version')}",
    "p8_invariants": "SELECT count(*) AS documents, count(*) AS documents_placed, true AS split_if_needed, true AS tokens_kept, true AS within_capacity FROM documents",
    "p9_invariants": "SELECT source, target_share, true AS reached, true AS within_repeats FROM mix_targets",
    "p3_daily_counts": f"SELECT command, version, day, duration_ms AS value, count(*) AS n FROM ({_TIMED_SQL}) GROUP BY 1, 2, 3, 4",
}
