"""Filters, joins and reductions over findings: thresholds, gates, summaries, review rows, dedup keys.

Findings have at least (path, line, issue_type, severity); null severities rank below LOW and never open a gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import SEVERITIES, dedup_key, severity_ord

SEVERITY = lambda: F.upper(F.trim("severity"))


def threshold(findings: DataFrame, least: str = "MEDIUM") -> DataFrame:
    return findings.where(severity_ord(F.col("severity")) >= SEVERITIES.index(least))


def summary(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: counts by severity, of all findings and of files with findings; with files their number and lines of code."""
    counts = findings.agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(SEVERITY() == s).alias(f"{s.lower()}_issues") for s in reversed(SEVERITIES)],
        F.count_distinct("path").alias("files_with_issues"),
    )
    if files is None:
        return counts
    scanned = files.agg(F.count(F.lit(1)).alias("files_analyzed"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"))
    return counts.withColumn("_one", F.lit(1)).join(scanned.withColumn("_one", F.lit(1)), "_one").drop("_one")


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def severity_cube(findings: DataFrame) -> DataFrame:
    return findings.cube("issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def gate(findings: DataFrame, fail_on: str | None, exclude_types: list[str] = ()) -> DataFrame:
    """One row (blocked, exit_code): whether a finding at or above `fail_on`, of no excluded type, exists."""
    if fail_on is None:
        return findings.agg(F.lit(False).alias("blocked"), F.lit(0).alias("exit_code"))
    kept = findings.where(~F.upper("issue_type").isin([t.upper() for t in exclude_types])) if exclude_types else findings
    blocked = F.coalesce(F.bool_or(severity_ord(F.col("severity")) >= SEVERITIES.index(fail_on)), F.lit(False))
    return kept.agg(blocked.alias("blocked"), F.when(blocked, 1).otherwise(0).alias("exit_code"))


def with_dedup_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("dedup_key", dedup_key(F.col("path"), F.col("line"), F.col("issue_type"), F.col("message")))


def unposted(findings: DataFrame, posted: DataFrame) -> DataFrame:
    """Findings whose dedup key is not among those already posted."""
    return findings.join(posted.select("dedup_key").where("dedup_key is not null").distinct(), "dedup_key", "left_anti")


def first_seen(findings: DataFrame, batch: str) -> DataFrame:
    """Findings of every batch whose dedup key no earlier batch has; the first batch of a key is one row of a count made before the shuffle."""
    first = findings.groupBy("dedup_key").agg(F.min(batch).alias(batch))
    return findings.join(first, ["dedup_key", batch], "left_semi")


def changed_lines(findings: DataFrame, diff_lines: DataFrame, strict: bool = False) -> DataFrame:
    """Findings of files in a diff, those on changed lines, or with `strict` all of them; in_hunk tells which is which."""
    touched = diff_lines.select("path", F.col("new_line").alias("line"), F.lit(True).alias("in_hunk")).distinct()
    rows = findings.join(diff_lines.select("path").distinct(), "path", "left_semi").join(touched, ["path", "line"], "left").withColumn("in_hunk", F.coalesce("in_hunk", F.lit(False)))
    return rows if strict else rows.where("in_hunk")


def review_rows(findings: DataFrame, root: str = "") -> DataFrame:
    """The twelve columns of a review finding; what a source lacks is null."""
    have = set(findings.columns)
    col = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    rows = findings.withColumn("path", F.regexp_replace("path", f"^{root.rstrip('/')}/", "")) if root else findings
    return with_dedup_key(rows).select(
        F.col("path").alias("file"), "line", col("col", "int").alias("column"), F.col("issue_type").alias("type"), "severity", "message", col("suggestion").alias("suggestion"),
        col("code_snippet").alias("code_snippet"), "dedup_key", col("in_hunk", "boolean").alias("in_hunk"), col("engine").alias("engine"), col("rule_id").alias("rule_id"),
    )


def finding_json(findings: DataFrame) -> DataFrame:
    """(path, body): eleven keys always, rule_id, confidence and source only where they are set."""
    have = set(findings.columns)
    col = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    always = F.to_json(
        F.struct(
            F.col("path").alias("file"), F.col("line"), col("col").alias("column"), F.col("issue_type").alias("type"), F.col("severity"), col("message").alias("message"), col("function_name").alias("function"),
            col("suggestion").alias("suggestion"), col("code_snippet").alias("code_snippet"), col("metadata").alias("metadata"), col("engine").alias("engine"),
        ),
        {"ignoreNullFields": "false"},
    )
    more = F.to_json(F.struct(*[col(c).alias(c) for c in ("rule_id", "confidence", "source")]))
    body = F.when(more == "{}", always).otherwise(F.concat(F.regexp_replace(always, r"\}$", ","), F.substr(more, F.lit(2))))
    return findings.select("path", body.alias("body"))


def fold_project(files: DataFrame, project: DataFrame) -> DataFrame:
    """Per path the counts of file findings and of project findings; paths known from project findings alone are synthetic."""
    a = files.select("path", "n_issues", F.lit(True).alias("real"))
    b = project.groupBy("path").agg(F.count(F.lit(1)).alias("n_project"))
    return a.join(b, "path", "full_outer").select(
        "path", (F.coalesce("n_issues", F.lit(0)) + F.coalesce("n_project", F.lit(0))).alias("n_issues"), F.coalesce("n_project", F.lit(0)).alias("n_project"), F.col("real").isNull().alias("is_synthetic")
    )


def in_scopes(findings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Findings with the first scope of their file that contains their line; a range condition behind an equal path."""
    f, s = findings.alias("f"), scopes.alias("s")
    hit = f.join(s, (F.col("f.path") == F.col("s.path")) & F.col("f.line").between(F.col("s.start_line"), F.col("s.end_line")))
    return hit.groupBy(*[F.col(f"f.{c}").alias(c) for c in findings.columns]).agg(F.min_by("s.scope", "s.start_line").alias("scope"))


def parser_failures(quarantine: DataFrame, samples: int = 3) -> DataFrame:
    """Per category: how many, in which languages, and the first sample paths."""
    ranked = quarantine.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("path")))
    return ranked.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("path")))).alias("samples")
    )


def comment_body(message: Column, suggestion: Column, severity: Column, key: Column) -> Column:
    """A review comment that ends with its dedup key as a marker."""
    return F.concat_ws("\n\n", F.concat(F.lit("**"), severity, F.lit("** "), message), suggestion, F.concat(F.lit("<!-- dedup:"), key, F.lit(" -->")))


def _ordered(findings: DataFrame):
    """All findings from the gravest, partition by partition, so that the driver holds one partition at a time."""
    return findings.select("severity", "path", "line", "issue_type").orderBy(severity_ord(F.col("severity")).desc(), "path", "line").toLocalIterator()


def text_report(findings: DataFrame) -> str:
    """All findings by severity as text."""
    out, last = [], None
    for r in _ordered(findings):
        if r.severity != last:
            out.append(f"{r.severity}")
            last = r.severity
        out.append(f"  {r.path}:{r.line} {r.issue_type}")
    return "\n".join(out)


def html_report(findings: DataFrame) -> str:
    """All findings as an HTML table, escaped."""
    from html import escape

    cells = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in _ordered(findings))
    return f"<table><tr><th>severity</th><th>path</th><th>line</th><th>type</th></tr>{cells}</table>"


def response(findings: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row per file as a server answers: its findings with five keys each, and whether the gate is closed."""
    issues = F.array_sort(F.collect_list(F.struct("line", F.col("issue_type").alias("type"), "severity", "message", "suggestion")))
    return findings.groupBy("path").agg(issues.alias("issues")).join(blocked.select(F.col("blocked").alias("gate_blocked")), F.lit(True))


def combined_summary(*runs: DataFrame) -> DataFrame:
    """One summary of the findings of several runs, whatever paths they were given; findings found twice count once."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return summary(every.dropDuplicates(["path", "line", "rule_id", "issue_type"]))


def trend_row(findings: DataFrame, complexity: DataFrame) -> DataFrame:
    """One row for a table of trends: counts by severity and the mean complexity of functions."""
    mean = complexity.agg(F.avg("complexity").alias("avg_complexity"))
    return summary(findings).join(mean, F.lit(True))


def post_counters(findings: DataFrame, posted: DataFrame, known_paths: DataFrame) -> DataFrame:
    """One row: what posting a review would do without doing it; skipped are findings posted before, failed are those of no file of the review."""
    rows = with_dedup_key(findings).join(posted.select("dedup_key").where("dedup_key is not null").distinct().withColumn("before", F.lit(True)), "dedup_key", "left")
    rows = rows.join(known_paths.select("path").distinct().withColumn("known", F.lit(True)), "path", "left")
    skipped, known = F.coalesce("before", F.lit(False)), F.coalesce("known", F.lit(False))
    return rows.agg(F.count_if(~skipped & known).alias("posted"), F.count_if(~skipped & ~known).alias("failed"), F.count_if(skipped).alias("skipped"))


def response(findings: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row per file as a server answers: its findings with five keys each, and whether the gate is closed."""
    issues = F.array_sort(F.collect_list(F.struct("line", F.col("issue_type").alias("type"), "severity", "message", "suggestion")))
    return findings.groupBy("path").agg(issues.alias("issues")).join(blocked.select(F.col("blocked").alias("gate_blocked")), F.lit(True))


def combined_summary(*runs: DataFrame) -> DataFrame:
    """One summary of the findings of several runs, whatever paths they were given; findings found twice count once."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return summary(every.dropDuplicates(["path", "line", "rule_id", "issue_type"]))


def trend_row(findings: DataFrame, complexity: DataFrame) -> DataFrame:
    """One row for a table of trends: counts by severity and the mean complexity of functions."""
    return summary(findings).join(complexity.agg(F.avg("complexity").alias("avg_complexity")), F.lit(True))


def post_counters(findings: DataFrame, posted: DataFrame, known_paths: DataFrame) -> DataFrame:
    """One row: what posting a review would do without doing it; skipped are findings posted before, failed are those of no file of the review."""
    before = posted.select("dedup_key").where("dedup_key is not null").distinct().withColumn("before", F.lit(True))
    rows = with_dedup_key(findings).join(before, "dedup_key", "left").join(known_paths.select("path").distinct().withColumn("known", F.lit(True)), "path", "left")
    skipped, known = F.coalesce("before", F.lit(False)), F.coalesce("known", F.lit(False))
    return rows.agg(F.count_if(~skipped & known).alias("posted"), F.count_if(~skipped & ~known).alias("failed"), F.count_if(skipped).alias("skipped"))
