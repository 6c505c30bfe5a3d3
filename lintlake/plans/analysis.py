"""The analysis of a corpus as one call: detection, every analyzer, project findings, threshold, gate and report.

An analyzer is a function from (path, content, language) to findings (path, line, rule_id, issue_type, severity,
confidence); a project analyzer is one from the same rows to findings of the project. Both can be registered. One that
fails while its plan is made gives a row of errors and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import lines_of_code
from lintlake.operators import configs, diffs, file_rules, findings, python_code, rules, sql_statements
from lintlake.operators.catalog_rules import FAMILIES
from lintlake.sources.files import detect_language

Analyzer = Callable[[DataFrame], DataFrame]
COLUMNS = "path string, line int, rule_id string, issue_type string, severity string, confidence double"


def shaped(rows: DataFrame) -> DataFrame:
    """Findings with the six columns, what a rule doesn't give being null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in COLUMNS.split(", "))])


def _python(files: DataFrame) -> DataFrame:
    src = files.where("language = 'python'")
    nodes = python_code.definitions(src)
    found = shaped(python_code.complexity_findings(nodes)).unionByName(shaped(python_code.smell_findings(nodes, params_too=True)))
    return found.unionByName(shaped(python_code.fact_findings(python_code.facts(src))))


def _configs(files: DataFrame) -> DataFrame:
    out = None
    for kind in ("json", "toml", "yaml"):
        found = shaped(configs.config_findings(configs.key_values(files.where(F.col("language") == kind), kind)))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("line", F.coalesce("line", F.lit(1)))


def _files(files: DataFrame) -> DataFrame:
    of = lambda kind: files.where(F.col("language") == kind)
    return shaped(file_rules.missing_safety_flags(of("shell"))).unionByName(shaped(file_rules.image_users(of("dockerfile"))))


@dataclass
class Registry:
    """The analyzers of an engine, by name."""

    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    project: dict[str, Analyzer] = field(default_factory=dict)

    def register(self, name: str, analyzer: Analyzer) -> None:
        self.analyzers[name] = analyzer

    def register_project(self, name: str, analyzer: Analyzer) -> None:
        self.project[name] = analyzer


def standard() -> Registry:
    """The engine's own analyzers."""
    out = Registry()
    out.register("lines", lambda files: rules.findings_of(files, list(FAMILIES)))
    out.register("sql", lambda files: sql_statements.statement_findings(sql_statements.statements(files.where("language = 'sql'"))))
    out.register("python", _python)
    out.register("configs", _configs)
    out.register("files", _files)
    for name in ("powershell", "groovy"):
        out.register(name, lambda files, name=name: rules.content_findings(files.where(F.col("language") == name), name))
    return out


@dataclass
class Analysis:
    """The findings of a run, the failures of analyzers as (analyzer, stage, error), and the files that were read."""

    findings: DataFrame
    failures: list[tuple[str, str, str]]
    files: DataFrame


def analyze(files: DataFrame, registry: Registry | None = None, threshold: str = "LOW", exclude_types: tuple[str, ...] = ()) -> Analysis:
    """Run all analyzers over (path, content). Findings below the threshold or of an excluded type are left out."""
    registry = registry or standard()
    rows = files.select("path", "content").withColumn("language", detect_language(F.col("path")))
    out, failures = None, []
    for stage, analyzers in (("file", registry.analyzers), ("project", registry.project)):
        for name, analyzer in analyzers.items():
            try:
                found = shaped(analyzer(rows)).withColumn("engine", F.lit(name))
            except Exception as e:  # an analyzer of somebody else's must not end the run
                failures.append((name, stage, type(e).__name__))
                continue
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select("path", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in COLUMNS.split(", ")[1:])], F.lit("").alias("engine")).limit(0)
    kept = findings.threshold(out, threshold)
    if exclude_types:
        kept = kept.where(~F.upper("issue_type").isin([t.upper() for t in exclude_types]))
    return Analysis(kept, failures, rows)


def report(run: Analysis, fail_on: str | None = None) -> DataFrame:
    """One row: the summary with files and lines of code, the gate, and the analyzers that failed."""
    files = run.files.select("path", lines_of_code(F.col("content")).alias("loc"))
    failed = F.array().cast("array<struct<analyzer:string,stage:string,error:string>>")
    if run.failures:
        failed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("analyzer", "stage", "error"), f)]) for f in run.failures])
    gate = findings.gate(run.findings, fail_on)
    return findings.summary(run.findings, files).join(gate, F.lit(True)).withColumn("failures", failed)


def review(files: DataFrame, patch: DataFrame, posted: DataFrame | None = None, registry: Registry | None = None, threshold: str = "MEDIUM", strict: bool = False) -> DataFrame:
    """Review rows of a patch (diff_id, body): analysis of the files it touches, findings on its lines, those not yet posted."""
    touched = diffs.diff_lines(patch).select("path", "new_line").distinct()
    run = analyze(files.join(touched.select("path").distinct(), "path", "left_semi"), registry, threshold)
    rows = findings.review_rows(findings.changed_lines(run.findings.withColumn("message", F.col("issue_type")), touched, strict))
    return findings.unposted(rows, posted) if posted is not None else rows
