"""Queries over exports, telemetry and post-deploy aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import aggregates, configs
from lintlake.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file's fields against the file before it in its stream."""
    from lintlake.operators.schema_drift import changes

    return changes(table(spark, sf_dir, "export_lines"))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All export records under one schema, what does not fit it kept as JSON."""
    from lintlake.operators.schema_drift import consistent_table

    out = consistent_table(table(spark, sf_dir, "export_lines"))
    return out.withColumn("rescued", F.to_json("rescued"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of three metrics that cannot be true or do not fit their source."""
    from lintlake.operators.implausible import flags

    return flags(table(spark, sf_dir, "aggregates")).select("agg_id", "metric")


def aggregate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every breach of the contract by a row of the aggregates."""
    return aggregates.violations(table(spark, sf_dir, "aggregates"), strict=True)


def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome labels of the latest records."""
    rows = aggregates.latest_reports(table(spark, sf_dir, "aggregates"))
    return rows.select("repo", "commit_sha", "obs_window", "agg_id", aggregates.outcome().alias("label"))


def events_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, failures and duration per hour and command."""
    return aggregates.tumbling(table(spark, sf_dir, "telemetry_events"), "1 hour", ["command"])


def events_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.tumbling(table(spark, sf_dir, "telemetry_events"), "24 hours", ["command"])


def feedback_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of issues, a known confidence standing in for an answer."""
    rows = table(spark, sf_dir, "analysis_issues").select((F.col("confidence") >= 0.7).alias("accepted"), "confidence")
    out = aggregates.feedback(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("acceptance_rate", "avg_confidence")})


def budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, tokens, days and cost per installation."""
    rows = table(spark, sf_dir, "telemetry_events").select(F.col("install_id").alias("owner"), "ts", F.coalesce("duration_ms", F.lit(0)).alias("tokens"), (F.lit(1) * F.coalesce("exit_code", F.lit(0))).cast("double").alias("cost"))
    return aggregates.budget(rows, 100.0)


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the events' JSON properties by key."""
    kv = configs.key_values(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content")), "json")
    return kv.groupBy("key_path", "value_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value_str").alias("values"))


QUERIES = {
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p6_found": p6_found,
    "aggregate_violations": aggregate_violations,
    "outcome_labels": outcome_labels,
    "events_1h": events_1h,
    "events_24h": events_24h,
    "feedback_metrics": feedback_metrics,
    "budget_summary": budget_summary,
    "event_properties": event_properties,
}

_MISSING = " UNION ALL ".join(f"SELECT agg_id, 'missing {c}' AS violation FROM aggregates WHERE {c} IS NULL" for c in ("repo", "commit_sha", "obs_window", "ts", "restart_count", "oom_kill_count", "error_rate"))
_STRICT = " UNION ALL ".join(f"SELECT agg_id, '(strict) missing {c}' FROM aggregates WHERE {c} IS NULL" for c in ("latency_p95_delta", "latency_p99_delta", "memory_rss_slope"))


def _window_sql(step: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{step}', ts, TIMESTAMP '1970-01-01') AS window_start, command, count(*) AS events, count(*) FILTER (exit_code <> 0) AS failures, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
      FROM telemetry_events WHERE ts IS NOT NULL GROUP BY 1, 2"""


SQL: dict[str, str] = {
    "aggregate_violations": f"""{_MISSING} UNION ALL {_STRICT}
      UNION ALL SELECT agg_id, 'repo format' FROM aggregates WHERE NOT regexp_matches(repo, '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$')
      UNION ALL SELECT agg_id, 'commit_sha format' FROM aggregates WHERE NOT regexp_matches(commit_sha, '^[0-9a-fA-F]{{7,}}$')
      UNION ALL SELECT agg_id, 'obs_window value' FROM aggregates WHERE obs_window NOT IN ('1h', '24h')
      UNION ALL SELECT agg_id, 'restart_count negative' FROM aggregates WHERE restart_count < 0
      UNION ALL SELECT agg_id, 'oom_kill_count negative' FROM aggregates WHERE oom_kill_count < 0
      UNION ALL SELECT agg_id, 'error_rate range' FROM aggregates WHERE error_rate < 0 OR error_rate > 1""",
    "outcome_labels": """WITH l AS (SELECT * FROM aggregates QUALIFY row_number() OVER (PARTITION BY repo, commit_sha, obs_window ORDER BY ts DESC NULLS LAST, received_at DESC NULLS LAST, agg_id DESC) = 1)
      SELECT repo, commit_sha, obs_window, agg_id, CASE WHEN coalesce(error_rate >= 0.05 OR oom_kill_count > 0 OR restart_count > 3, false) THEN 2
        WHEN coalesce(error_rate >= 0.01 OR latency_p99_delta > 200 OR memory_rss_slope > 10, false) THEN 1 ELSE 0 END AS label FROM l""",
    "events_1h": _window_sql("1 hour"),
    "events_24h": _window_sql("24 hours"),
    "feedback_metrics": """SELECT count(*) AS total, count(*) FILTER (confidence >= 0.7) AS accepted, count(*) FILTER (confidence < 0.7) AS rejected, count(*) FILTER (confidence IS NULL) AS pending,
      round(count(*) FILTER (confidence >= 0.7) / count(confidence), 6) AS acceptance_rate, round(avg(confidence), 6) AS avg_confidence FROM analysis_issues""",
    "budget_summary": """SELECT install_id AS owner, count(*) AS requests, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS tokens, count(DISTINCT CAST(ts AS DATE)) AS active_days, CAST(sum(coalesce(exit_code, 0)) AS DOUBLE) AS cost,
      100 * CAST(sum(coalesce(exit_code, 0)) AS DOUBLE) / 100.0 AS utilisation_pct FROM telemetry_events GROUP BY 1""",
    "event_properties": """SELECT k AS key_path, CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS value_type, count(*) AS n,
      count(DISTINCT json_extract_string(props, '$.' || k)) AS values FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2""",
}
