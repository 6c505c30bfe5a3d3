import json
from datetime import datetime, timedelta

from lintlake.operators.schema_drift import changes, consistent_table, ingest, promote

SCHEMA = "line_id bigint, stream string, file_name string, exported_at timestamp, line_no int, body string, path string"


def lines(spark, exports, clash="x"):
    rows = []
    for k, (stream, name, hour, records) in enumerate(exports):
        for i, r in enumerate(records):
            rows.append((len(rows), stream, name, datetime(2025, 1, 1) + timedelta(hours=hour), i, r if r is None or isinstance(r, str) else json.dumps(r), clash))
    return spark.createDataFrame(rows, SCHEMA)


def event(i, **more):
    return {"event_key": f"k{i}", "command": f"c{i}", "duration_ms": i} | more


def exports():
    first = [event(i, rule_id=f"r{i}", gone=i, meta={"a": 1}) for i in range(20)]
    second = [event(i, ruleId=f"r{i}", added=[1], meta={"a": {"b": 2}}) for i in range(15, 40)]
    third = [{**event(i, ruleId=f"r{i}", meta={"a": {"b": 2}}), "duration_ms": str(i)} for i in range(35, 60)] + ["{cut", None, "[1]", '"x"', "{\"a\": NaN}"]
    return [("s", "f3", 3, third), ("s", "f1", 1, first), ("s", "f2", 2, second), ("other", "f1", 1, first)]


def test_changes(spark):
    got = {tuple(r) for r in changes(lines(spark, exports())).collect()}
    assert got == {
        ("s", "f2", "renamed", "rule_id", "ruleId"), ("s", "f2", "removed", "gone", ""), ("s", "f2", "added", "added", ""), ("s", "f2", "removed", "meta.a", ""), ("s", "f2", "added", "meta.a.b", ""),
        ("s", "f3", "removed", "added", ""), ("s", "f3", "retyped", "duration_ms", ""),
    }
    assert changes(lines(spark, exports()).limit(0)).count() == 0


def test_sparse_fields_are_in_no_file(spark):
    a = [event(i) for i in range(30)]
    b = [event(i, **({"stray": 1} if i == 0 else {})) for i in range(30)]
    assert changes(lines(spark, [("s", "a", 1, a), ("s", "b", 2, b)])).count() == 0


def test_nothing_is_lost_and_replayed(spark):
    table = ingest(lines(spark, exports()))
    rows = table.collect()
    assert sum(r.corrupt is not None for r in rows) == 5 and "path" in table.columns
    text = [r for r in rows if r.file_name == "f3" and r.corrupt is None]
    assert all(r.duration_ms is None and json.loads(r.rescued["duration_ms"]).isdigit() for r in text)
    back = promote(table, {"duration_ms": ("double", ["duration_ms"]), "rule_id": ("string", ["ruleId"]), "b": ("int", ["meta.a.b"])})
    assert back.where("corrupt is null and duration_ms is null").count() == 0
    assert back.where("file_name = 'f2' and (rule_id is null or b <> 2)").count() == 0
    whole = consistent_table(lines(spark, exports()))
    assert whole.where("corrupt is null and (duration_ms is null or rule_id is null)").count() == 0


def test_very_long_and_deep_lines(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = [event(0, t="x" * 200_000), deep, "", "null"]
    got = {r.line_no: r.corrupt for r in ingest(lines(spark, [("s", "a", 1, rows)])).collect()}
    assert got == {0: None, 1: deep, 2: "", 3: "null"}
