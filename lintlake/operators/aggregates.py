"""Post-deploy aggregates: validation, outcome labels, windows and the latest record; telemetry events and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.drift import latest

# The formats and thresholds of the contract.
REPO = r"^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$"
SHA = r"^[0-9a-fA-F]{7,}$"
WINDOWS = ["1h", "24h"]
MOMENT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
MOMENT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
RED = {"error_rate": 0.05, "oom_kill_count": 0, "restart_count": 3}
YELLOW = {"error_rate": 0.01, "latency_p99_delta": 200.0, "memory_rss_slope": 10.0}


def violations(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(agg_id, violation): every breach of the contract by a row; columns read as text are checked for their format as well."""
    e = lambda test, text: F.when(test, F.lit(text))
    checks = [e(F.col(c).isNull(), f"missing {c}") for c in ("repo", "commit_sha", "obs_window", "ts", "restart_count", "oom_kill_count", "error_rate")]
    checks += [
        e(~F.col("repo").rlike(REPO), "repo format"),
        e(~F.col("commit_sha").rlike(SHA), "commit_sha format"),
        e(~F.col("obs_window").isin(WINDOWS), "obs_window value"),
        e(F.col("restart_count").try_cast("double") < 0, "restart_count negative"),
        e(F.col("oom_kill_count").try_cast("double") < 0, "oom_kill_count negative"),
        e((F.col("error_rate").try_cast("double") < 0) | (F.col("error_rate").try_cast("double") > 1), "error_rate range"),
    ]
    kinds = dict(rows.dtypes)
    if kinds["ts"] == "string":
        checks.append(e(~F.col("ts").rlike(MOMENT), "ts format"))
    for c in ("restart_count", "oom_kill_count"):
        if kinds[c] in ("string", "double", "float"):
            checks.append(e(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(r"^-?\d+(?:\.0)?$"), f"{c} not an integer"))
    for c in ("error_rate", "latency_p95_delta", "latency_p99_delta", "memory_rss_slope"):
        if kinds.get(c) == "string":
            checks.append(e(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), f"{c} not numeric"))
    kinds = dict(rows.dtypes)
    if kinds["ts"] == "string":
        checks.append(e(~F.col("ts").rlike(MOMENT), "ts format"))
    for c in ("restart_count", "oom_kill_count"):
        if kinds[c] in ("string", "double", "float"):
            checks.append(e(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(r"^-?\d+(?:\.0)?$"), f"{c} not an integer"))
    for c in ("error_rate", "latency_p95_delta", "latency_p99_delta", "memory_rss_slope"):
        if kinds.get(c) == "string":
            checks.append(e(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), f"{c} not numeric"))
    if strict:
        checks += [e(F.col(c).isNull(), f"(strict) missing {c}") for c in ("latency_p95_delta", "latency_p99_delta", "memory_rss_slope")]
    return rows.select("agg_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def outcome(red: dict = RED, yellow: dict = YELLOW) -> Column:
    """2 RED, 1 YELLOW, 0 GREEN; missing metrics give no signal."""
    is_red = (F.col("error_rate") >= red["error_rate"]) | (F.col("oom_kill_count") > red["oom_kill_count"]) | (F.col("restart_count") > red["restart_count"])
    is_yellow = (F.col("error_rate") >= yellow["error_rate"]) | (F.col("latency_p99_delta") > yellow["latency_p99_delta"]) | (F.col("memory_rss_slope") > yellow["memory_rss_slope"])
    return F.when(F.coalesce(is_red, F.lit(False)), 2).when(F.coalesce(is_yellow, F.lit(False)), 1).otherwise(0)


def latest_reports(rows: DataFrame) -> DataFrame:
    """The latest record of every (repo, commit, window)."""
    return latest(rows, ["repo", "commit_sha", "obs_window"], ["ts", "received_at", "agg_id"])


def tumbling(events: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """Events, failures and duration per window and key."""
    return (
        events.groupBy(F.window("ts", width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("exit_code") != 0).alias("failures"), F.sum("duration_ms").alias("duration_ms"))
        .select(F.col("w.start").alias("window_start"), *keys, "events", "failures", "duration_ms")
    )


def feedback(rows: DataFrame) -> DataFrame:
    """One row of acceptance metrics over (accepted, confidence); a null answer is pending."""
    answered = F.count("accepted")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.col("accepted").isNull()).alias("pending"),
        F.when(answered > 0, F.count_if("accepted") / answered).otherwise(0.0).alias("acceptance_rate"), F.avg("confidence").alias("avg_confidence"),
    )


def budget(rows: DataFrame, limit: float) -> DataFrame:
    """Requests, tokens, active days, cost and use of a limit per owner, over (owner, ts, tokens, cost)."""
    return rows.groupBy("owner").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.sum("cost").alias("cost"), (100 * F.sum("cost") / limit).alias("utilisation_pct")
    )
