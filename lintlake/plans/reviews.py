"""Queries over reported issues: thresholds, dedup keys, reviews, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import distribution_name, html_escape, newer, normal_message, sanitised_args, severity_ord
from lintlake.operators import findings
from lintlake.operators.drift import latest
from lintlake.session import table

PAYLOAD = "coalesce(file_path, '') || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || coalesce(issue_type, '') || '|' || coalesce({m}, '')"
NORMAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(message, '^\s+|\s+$', '', 'g')), '(?:/[\w.\-]+)+', '<path>', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '')"""
KEY_SQL = "'sha256:' || sha256(" + PAYLOAD.format(m=NORMAL_SQL) + ")"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analysis_issues").withColumnRenamed("file_path", "path")


def issues_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of severity HIGH and above, by repository and type."""
    return findings.threshold(issues(spark, sf_dir), "HIGH").groupBy("repo", "issue_type").agg(F.count(F.lit(1)).alias("n"), F.max(severity_ord(F.col("severity"))).alias("gravest"))


def issues_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).groupBy("engine", F.upper(F.trim("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable keys of all issues."""
    return findings.with_dedup_key(issues(spark, sf_dir)).select("issue_id", "dedup_key")


def dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of every batch whose key no earlier batch has."""
    keyed = findings.with_dedup_key(issues(spark, sf_dir))
    return findings.first_seen(keyed, "batch_id").select("issue_id", "dedup_key")


def _changed(rows: DataFrame) -> DataFrame:
    """Lines that batches after the first report on, as the lines of a diff."""
    return rows.where("batch_id > 1").select("path", F.col("line").alias("new_line")).distinct()


def review_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues on changed lines, those that later batches report on standing in for a diff."""
    rows = issues(spark, sf_dir)
    return findings.changed_lines(rows, _changed(rows)).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def review_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issues(spark, sf_dir)
    return findings.changed_lines(rows, _changed(rows), strict=True).groupBy("in_hunk").agg(F.count(F.lit(1)).alias("n"))


def review_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve columns of review findings."""
    return findings.review_rows(issues(spark, sf_dir)).select("file", "line", "column", "type", "severity", "dedup_key", "engine", "rule_id")


def finding_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as JSON, keys that are optional only where they are set."""
    return findings.finding_json(issues(spark, sf_dir))


def fold_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues per file beside cloud findings of the same path, outer joined."""
    files = issues(spark, sf_dir).withColumn("path", F.concat_ws("/", "repo", F.lit("x"), F.col("line") % 50)).groupBy("path").agg(F.count(F.lit(1)).alias("n_issues"))
    project = table(spark, sf_dir, "cloud_findings").select(F.concat_ws("/", "repo", F.lit("x"), F.col("start_line") % 60).alias("path"))
    return findings.fold_project(files, project)


def latest_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last issue reported for every file and type."""
    return latest(issues(spark, sf_dir), ["repo", "path", "issue_type"], ["detected_at", "issue_id"]).select("repo", "path", "issue_type", "issue_id")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over messages."""
    rows = issues(spark, sf_dir)
    return rows.select("issue_id", normal_message(F.col("message")).alias("normal"), html_escape(F.col("message")).alias("escaped"), distribution_name(F.col("rule_id")).alias("name"))


def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether their version is newer than 4.4.0."""
    rows = table(spark, sf_dir, "telemetry_events")
    return rows.groupBy(newer(F.col("version"), F.lit("4.4.0")).alias("newer")).agg(F.count(F.lit(1)).alias("n"))


def args_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with paths and secret-looking words replaced, digested."""
    return issues(spark, sf_dir).select("issue_id", F.sha2(sanitised_args(F.col("message")), 256).alias("digest"))


QUERIES = {
    "issues_threshold": issues_threshold,
    "issues_by_engine": issues_by_engine,
    "dedup_keys": dedup_keys,
    "dedup_anti": dedup_anti,
    "review_changed": review_changed,
    "review_strict": review_strict,
    "review_schema": review_schema,
    "finding_json": finding_json,
    "fold_project": fold_project,
    "latest_per_place": latest_per_place,
    "scalar_functions": scalar_functions,
    "newer_versions": newer_versions,
    "args_sanitised": args_sanitised,
}

_ORD = "CASE upper(trim(severity)) WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END"
_CHANGED = "SELECT DISTINCT file_path, line FROM analysis_issues WHERE batch_id > 1"
SQL = {
    "issues_threshold": f"SELECT repo, issue_type, count(*) AS n, max({_ORD}) AS gravest FROM analysis_issues WHERE {_ORD} >= 2 GROUP BY 1, 2",
    "issues_by_engine": "SELECT engine, upper(trim(severity)) AS severity, count(*) AS n FROM analysis_issues GROUP BY 1, 2",
    "dedup_keys": f"SELECT issue_id, {KEY_SQL} AS dedup_key FROM analysis_issues",
    "args_sanitised": r"""SELECT issue_id, sha256(array_to_string(list_transform(regexp_split_to_array(message, '\s+'), lambda w: CASE WHEN regexp_matches(w, '[/\\]') THEN '<path>' WHEN regexp_matches(w, '@.*\.') THEN '<email>'
      WHEN regexp_matches(w, '(?i)(token|secret|password|key|credential)') THEN '<secret>' ELSE w END), ' ')) AS digest FROM analysis_issues""",
    "dedup_anti": f"WITH k AS (SELECT issue_id, batch_id, {KEY_SQL} AS dedup_key FROM analysis_issues) SELECT issue_id, dedup_key FROM k QUALIFY batch_id = min(batch_id) OVER (PARTITION BY dedup_key)",
    "review_changed": f"SELECT issue_type, count(*) AS n FROM analysis_issues JOIN ({_CHANGED}) USING (file_path, line) GROUP BY 1",
    "review_strict": f"""WITH c AS ({_CHANGED}) SELECT in_hunk, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM c WHERE c.file_path = a.file_path AND c.line = a.line) AS in_hunk FROM analysis_issues a
      WHERE a.file_path IN (SELECT file_path FROM c)) GROUP BY 1""",
    "review_schema": f'SELECT file_path AS file, line, col AS "column", issue_type AS type, severity, {KEY_SQL} AS dedup_key, engine, rule_id FROM analysis_issues',
    "fold_project": """WITH a AS (SELECT concat_ws('/', repo, 'x', line % 50) AS path, count(*) AS n_issues FROM analysis_issues GROUP BY 1),
      b AS (SELECT concat_ws('/', repo, 'x', start_line % 60) AS path, count(*) AS n_project FROM cloud_findings GROUP BY 1)
      SELECT coalesce(a.path, b.path) AS path, coalesce(n_issues, 0) + coalesce(n_project, 0) AS n_issues, coalesce(n_project, 0) AS n_project, a.path IS NULL AS is_synthetic FROM a FULL JOIN b ON a.path = b.path""",
    "latest_per_place": "SELECT repo, file_path AS path, issue_type, issue_id FROM analysis_issues QUALIFY row_number() OVER (PARTITION BY repo, file_path, issue_type ORDER BY detected_at DESC NULLS LAST, issue_id DESC) = 1",
    "scalar_functions": f"""SELECT issue_id, {NORMAL_SQL} AS normal, replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
      regexp_replace(lower(rule_id), '[-_.]+', '-', 'g') AS name FROM analysis_issues""",
    "newer_versions": r"""SELECT CASE WHEN version IS NULL THEN NULL ELSE list_transform(string_split(regexp_replace(version, '^[vV]', ''), '.'), lambda x: CAST(x AS INTEGER)) > [4, 4, 0] END AS newer, count(*) AS n FROM telemetry_events GROUP BY 1""",
}
