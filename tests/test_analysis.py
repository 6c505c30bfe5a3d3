"""Parts of analysis, cloud and reports that have no query of their own."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lintlake import session
from lintlake.operators import aggregates, cloud, configs, findings, masking, parity, python_code
from lintlake.plans import analysis

FINDING = "path string, line int, rule_id string, issue_type string, severity string, message string, suggestion string"


def rows(spark, n=3):
    return spark.createDataFrame([(f"f{i % 2}", i, "R", "T", ("LOW", "HIGH", "CRITICAL")[i % 3], "m", "s") for i in range(n)], FINDING)


def test_a_cluster_needs_a_shared_folder(spark):
    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))))
    assert session.is_local(spark) and not session.is_local(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "local-cluster[3,2,1024]")))


def test_scratch_tables_can_be_cleared(spark):
    df = session.stored(spark.range(5).toDF("x"), "t")
    assert df.count() == 5
    session.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(session.scratch_path(spark, "t").rsplit("/", 1)[0]).count()


def test_reports_list_every_finding(spark):
    f = rows(spark, 2500)
    assert findings.text_report(f).count("\n  ") == 2500 and findings.html_report(f).count("<tr>") == 2501
    assert findings.text_report(f.limit(0)) == ""


def test_summaries(spark):
    f = rows(spark)
    one = findings.combined_summary(f, f, rows(spark, 5)).collect()[0]
    assert (one.total_issues, one.files_with_issues) == (5, 2)
    trend = findings.trend_row(f, spark.createDataFrame([(4,), (8,)], "complexity int")).collect()[0]
    assert (trend.total_issues, trend.avg_complexity) == (3, 6.0)
    answer = {r.path: r for r in findings.response(f, findings.gate(f, "HIGH")).collect()}
    assert len(answer["f0"].issues) == 2 and answer["f0"].gate_blocked and set(answer["f0"].issues[0].asDict()) == {"line", "type", "severity", "message", "suggestion"}


def test_drift_summary_and_wildcards(spark):
    mapping = spark.createDataFrame([("t", "a", "1"), ("t", "b", None), ("u", "c", "2")], "path string, logical_id string, physical_id string")
    found = spark.createDataFrame([("t",), ("t",), ("v",)], "path string")
    assert {tuple(r) for r in cloud.drift_summary(mapping, found).collect()} == {("t", 1, 2), ("u", 1, 0), ("v", 0, 1)}
    words = spark.createDataFrame([("*",), (" s3:* ",), ("s3:Get",), (None,)], "v string")
    assert [r[0] for r in words.select(cloud.wildcard(F.col("v"))).collect()] == [True, True, False, False]
    empty = configs.key_values(spark.createDataFrame([("a", None), ("b", "")], "path string, content string"), "json")
    for platform in ("cloudformation", "arm", "serverless"):
        assert cloud.insecure_defaults(empty, platform).count() == 0
    assert cloud.expected_rules(empty).count() == 0


def test_analysis_of_nothing(spark):
    run = analysis.analyze(spark.createDataFrame([("a.py", None)], "path string, content string").limit(0), analysis.Registry())
    assert run.findings.count() == 0 and run.failures == []
    assert analysis.report(run).collect()[0].total_issues == 0
    kept = analysis.analyze(spark.createDataFrame([("a.sh", "curl x | sh\nrm $X/y\n")], "path string, content string"), threshold="HIGH", exclude_types=("shell_command_injection",))
    assert {r.rule_id for r in kept.findings.collect()} == {"SH_RCE1"}


def test_masked_context(spark):
    df = spark.createDataFrame([("a\npassword = 'abcdefgh'\nc\nd", 2), ("a", 9)], "content string, line int")
    one, none = masking.safe_context(df, "content", "line", 1).orderBy("line").collect()
    assert (one.context.text, one.context.start_line, one.context.end_line, one.context.redactions) == ("a\n[REDACTED]\nc", 1, 3, 1) and none.context is None


def test_formats_of_aggregates_read_as_text(spark):
    schema = "agg_id bigint, repo string, commit_sha string, obs_window string, ts string, restart_count double, oom_kill_count int, error_rate string, latency_p95_delta string, latency_p99_delta double, memory_rss_slope double"
    df = spark.createDataFrame([(1, "a/b", "abcdef0", "1h", "2025-01-01T00:00:00Z", 1.0, 0, "0.5", None, None, None), (2, "a/b", "abcdef0", "1h", "1 Jan 2025", 1.5, 0, "half", "x", None, None)], schema)
    assert {(r.agg_id, r.violation) for r in aggregates.violations(df).collect()} == {(2, "ts format"), (2, "restart_count not an integer"), (2, "error_rate not numeric"), (2, "latency_p95_delta not numeric")}


def test_bodies_and_definitions(spark):
    src = spark.createDataFrame([("a.py", "class K:\n    def f(self):\n        x = 1\n        return x\n\ndef g(): pass\n"), ("b.py", "def ("), ("n.py", None)], "path string, content string")
    assert [(r.name, r.line_start, r.line_end) for r in python_code.function_bodies(src).collect()] == [("f", 2, 4)]
    assert {r.name for r in python_code.definitions(src).collect()} == {"K", "f", "g"}


def test_parity_without_differences(spark):
    kv = configs.key_values(spark.createDataFrame([("w", "jobs:\n  a:\n    steps:\n      - run: flake8 --max-line-length=79 --ignore=E1\n      - run: flake8 --max-line-length=88\n")], "path string, content string"), "yaml")
    ci = parity.ci_flake8(kv)
    assert {(r.option, r.value) for r in ci.collect()} == {("max-line-length", "88"), ("ignore", "E1")}
    local = parity.local_flake8(spark.createDataFrame([("r", "r/pyproject.toml", "[tool.flake8]\nmax-line-length = 88\n"), ("r", "r/.flake8", "ignore = E1,E2\nmax-line-length=70\n")], "root string, path string, content string"))
    assert parity.flake8_parity(ci.withColumn("root", F.lit("r")), local).count() == 0
    assert parity.tool_parity(spark.createDataFrame([("w",)], "path string"), list(parity.TOOLS)).count() == 0
    assert parity.python_version_parity(parity.ci_python_versions(kv), "3.13").count() == 0
