from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lintlake.operators import aggregates
from lintlake.sources import files
from lintlake.streaming import aggregates as streams


def test_stream_equals_batch(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(t + timedelta(minutes=7 * i), "ab"[i % 2], i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, command string, exit_code int, duration_ms long")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed(source, "1 hour", ["command"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = aggregates.tumbling(df, "1 hour", ["command"])
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
    q = streams.sessions(source, "10 minutes", "command").writeStream.format("memory").queryName("s").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("s").agg(F.sum("events")).collect()[0][0] == 200


def test_new_files_are_analysed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.sql", "SELECT * FROM t\n")], "path string, content string").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    q = streams.analyse_new_files(source, "sql", str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["SQL030"]


def test_latest_stream(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("r", "c", "1h", t + timedelta(hours=h), float(h)) for h in (2, 5, 1)] + [("r", "d", "1h", t, None)]
    df = spark.createDataFrame(rows, streams.LATEST)
    df.write.parquet(str(tmp_path / "in"))
    q = streams.latest_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("l").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.commit_sha, r.error_rate) for r in spark.table("l").collect()} == {("c", 5.0), ("d", None)}


def test_aggregates(spark):
    schema = "agg_id long, repo string, commit_sha string, obs_window string, ts timestamp, received_at timestamp, restart_count long, oom_kill_count int, error_rate double, latency_p95_delta double, latency_p99_delta double, memory_rss_slope double"
    t = datetime(2025, 1, 1)
    rows = [
        (1, "a/b", "abcdef1", "1h", t, t, 0, 0, 0.0, None, None, None), (2, "a/b", "abcdef1", "1h", t + timedelta(hours=1), t, 0, 0, 0.02, 0.0, 0.0, 0.0), (3, "a/b", "abcdef2", "24h", t, t, 4, 0, 0.0, 0.0, 0.0, 0.0),
        (4, "ab", "xyz", "2h", None, t, -1, None, 1.5, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    bad = {r.violation for r in aggregates.violations(df).collect()}
    assert bad == {"missing ts", "missing oom_kill_count", "repo format", "commit_sha format", "obs_window value", "restart_count negative", "error_rate range"}
    labels = {r.agg_id: r.label for r in aggregates.latest_reports(df).select("agg_id", aggregates.outcome().alias("label")).collect()}
    assert labels == {2: 1, 3: 2, 4: 2}
    fb = aggregates.feedback(spark.createDataFrame([(True, 0.5), (False, 0.7), (None, None)], "accepted boolean, confidence double")).collect()[0]
    assert (fb.total, fb.pending, fb.acceptance_rate) == (3, 1, 0.5)


def test_sources(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n# y\n\n", "node_modules/b.py": "", "Dockerfile": "FROM a", "run": "#!/bin/bash\n", "x.tf.json": "{}", "c": "z", "empty.py": ""}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    rows = {r.path.rsplit("/", 1)[1]: (r.language, r.loc) for r in files.scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": ("python", 1), "Dockerfile": ("dockerfile", 1), "run": ("shell", 0), "x.tf.json": ("terraform", 1), "c": ("unknown", 1)}
    listed = files.explicit(spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int"), spark.createDataFrame([("a",), ("gone",), ("a",)], "path string"))
    assert [r.n for r in listed.collect()] == [1]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\nnope\n{"a": "x"}\n')
    got = files.json_lines(spark, str(tmp_path / "e.jsonl"), "a int").collect()
    assert [(r.a, r.bad is None) for r in got] == [(1, True), (None, False), (None, False)]
    assert files.under_root(str(tmp_path / "a.py"), str(tmp_path)).name == "a.py"
    with pytest.raises(ValueError):
        files.under_root(str(tmp_path / ".." / "x"), str(tmp_path))
    assert [r.provider for r in files.providers(spark, deny=["tfsec"]).where("language = 'terraform'").collect()] == ["tflint"]
    assert files.providers(spark, "internal").count() == 0
