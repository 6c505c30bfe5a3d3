"""Problem 2: one consistent table from files whose schema drifts, and a list of every change.

Rescue-column ingestion. `ingest` enforces a target schema on JSON lines: a field of the target type goes to its
typed column; unknown fields, fields of another type and fields inside objects (under their dotted path) stay as JSON
text in the map `rescued`; a line that is no JSON object stays whole in `corrupt`. `promote` gives approved fields a
typed column and replays the rescued values into it. Nothing is lost: every (path, type, value) of a record can be
had again from its typed columns and `rescued`, and `changes` compares files on just that.

A file's fields are counted in one pass with map-side aggregation, so only (file, field, type) counts are shuffled.
Renames are decided on the records that two files of a stream share, for removed and added fields only.

Numbers from 1e15 up, which a double may not hold exactly, stay in `rescued` as they are written; `promote` casts them.

Null body, non-JSON and cut-off lines: `corrupt`, in no count. Null stream or file name: its own stream or file. A
file without any record has no fields. Ties of types go to the first in alphabetical order; files exported at the
same time follow by name. Repeated records count again in shares, and once in renames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import materialise, spread, stored

# The fields of telemetry events and issues and their JSON types.
TARGET = {
    "event_key": "string",
    "ts": "string",
    "command": "string",
    "version": "string",
    "exit_code": "number",
    "duration_ms": "number",
    "schema_version": "number",
    "args_hash": "string",
    "issue_key": "string",
    "file_path": "string",
    "line": "number",
    "issue_type": "string",
    "severity": "string",
    "message": "string",
    "rule_id": "string",
    "confidence": "number",
    "engine": "string",
}
SQL_TYPES = {"string": "string", "number": "double", "boolean": "boolean"}
KEYS = ("event_key", "issue_key")
PRESENT = 0.1
SAME_VALUES = 0.6
BROADCAST_ROWS = 100_000


def _flatten(value: dict, prefix: str, out: list) -> None:
    for k, v in value.items():
        path = f"{prefix}{k}"
        if isinstance(v, dict):
            _flatten(v, f"{path}.", out)
        else:
            out.append((path, v))


def _no_constant(name: str):
    raise ValueError(name)


def _fits(value, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 1e15
    return isinstance(value, str if kind == "string" else bool)


def ingest(lines: DataFrame, target: dict[str, str] = TARGET, body: str = "body") -> DataFrame:
    """The lines with a typed column for every target field, `rescued` and `corrupt` in the place of the body."""
    keep = [c for c in lines.columns if c != body and c not in target and c not in ("rescued", "corrupt")]
    kinds = {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_()}
    kept = spread(lines.select(*keep, body))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != body] + [f"`{k}` {SQL_TYPES[t]}" for k, t in target.items()])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typed = {k: [] for k in target}
            rescued, corrupt = [], []
            for text in batch.column(body).to_pylist():
                fields: list = []
                try:
                    record = json.loads(text, parse_constant=_no_constant) if text is not None else None
                    if not isinstance(record, dict):
                        raise ValueError
                    _flatten(record, "", fields)
                except (ValueError, RecursionError):
                    for v in typed.values():
                        v.append(None)
                    rescued.append(None)
                    corrupt.append(text if text is not None else "")
                    continue
                row, rest = {}, {}
                for path, v in fields:
                    kind = target.get(path)
                    if v is not None and kind is not None and path in record and _fits(v, kind):
                        row[path] = float(v) if kind == "number" else v
                    elif v is not None:
                        rest[path] = json.dumps(v, ensure_ascii=False, sort_keys=True)
                for k, v in typed.items():
                    v.append(row.get(k))
                rescued.append(list(rest.items()))
                corrupt.append(None)
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(v, kinds[target[k]]) for k, v in typed.items()]
            arrays += [pa.array(rescued, pa.map_(pa.string(), pa.string())), pa.array(corrupt, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *target, "rescued", "corrupt"])

    return kept.mapInArrow(parse, schema + ", rescued map<string,string>, corrupt string")


def promote(table: DataFrame, approved: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Replay rescued values into typed columns.

    approved: column -> (type, rescued paths, the first that has a castable value counting). An existing column
    keeps its own values before those.
    """
    for column, (kind, paths) in approved.items():
        plain = [F.expr(f"try_cast(regexp_replace(try_element_at(rescued, '{p}'), '^\"|\"$', '') as {kind})") for p in paths]
        own = [F.col(f"`{column}`")] if column in table.columns else []
        table = table.withColumn(column, F.coalesce(*own, *plain))
    return table


def _fields(table: DataFrame, target: dict[str, str]) -> DataFrame:
    """A row per record and non-null field: path, kind, value as JSON text."""
    typed = [
        F.when(
            F.col(f"`{k}`").isNotNull(),
            F.struct(
                F.lit(k).alias("path"),
                F.lit(t).alias("kind"),
                (F.to_json(F.array(F.col(f"`{k}`"))) if t == "string" else F.format_string("%s", F.col(f"`{k}`").cast("decimal(38,6)")) if t == "number" else F.col(f"`{k}`").cast("string")).alias("value"),
            ),
        )
        for k, t in target.items()
    ]
    rest = F.expr(
        """transform(map_entries(rescued), e -> struct(e.key as path,
             case when left(e.value, 1) = '"' then 'string' when left(e.value, 1) = '[' then 'array'
                  when e.value in ('true', 'false') then 'boolean' else 'number' end as kind,
             case when left(e.value, 1) = '"' then concat('[', e.value, ']')
                  else coalesce(cast(try_cast(e.value as decimal(38,6)) as string), e.value) end as value))"""
    )
    own = [c for c in ("stream", "file_name", "record_key") if c in table.columns]
    return table.select(*own, F.explode(F.concat(F.array_compact(F.array(*typed)), F.coalesce(rest, F.array()))).alias("f")).select(*own, "f.*")


def file_order(lines: DataFrame) -> DataFrame:
    """(stream, file_name, exported_at, seq): the place of every file in its stream."""
    files = lines.groupBy("stream", "file_name").agg(F.min("exported_at").alias("exported_at"))
    return files.withColumn("seq", F.row_number().over(Window.partitionBy("stream").orderBy("exported_at", "file_name")))


def changes(lines: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """(stream, file_name, change_kind, field_name, new_name) of every file against the one before it in its stream."""
    lines = lines.withColumns({"stream": F.coalesce("stream", F.lit("")), "file_name": F.coalesce("file_name", F.lit(""))})
    order = file_order(lines.select("stream", "file_name", "exported_at"))
    order = stored(order.select("stream", "file_name", "seq"), "order")
    table = ingest(lines.select("stream", "file_name", "body"), target).where("corrupt is null")
    record = stored(table.withColumn("record_key", F.coalesce(*KEYS)).drop("corrupt"), "records")
    counts = (
        _fields(record, target)
        .groupBy("stream", "file_name", "path", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("stream", "file_name", "path")
        .agg(F.sum("n").alias("n"), F.max_by("kind", F.struct("n", F.translate("kind", "abnos", "zyxwv"))).alias("kind"))
    )
    records = record.groupBy("stream", "file_name").agg(F.count(F.lit(1)).alias("records"))
    held = counts.join(records, ["stream", "file_name"]).where(F.col("n") >= PRESENT * F.col("records")).join(order, ["stream", "file_name"]).select("stream", "seq", "path", "kind")
    pairs = order.where("seq > 1").select("stream", "seq", "file_name")
    old = held.select("stream", (F.col("seq") + 1).alias("seq"), "path", F.col("kind").alias("old_kind"))
    diff = (
        held.join(old, ["stream", "seq", "path"], "full_outer")
        .where("kind is null or old_kind is null or kind <> old_kind")
        .join(pairs, ["stream", "seq"])
        .select(
            "stream", "seq", "file_name", "path", F.when(F.col("kind").isNull(), "removed").when(F.col("old_kind").isNull(), "added").otherwise("retyped").alias("change_kind")
        )
    )
    diff = materialise(diff)
    renamed = _renames(record, diff, order, target)
    gone = renamed.select("stream", "seq", F.col("old").alias("path"), F.lit("removed").alias("change_kind")).unionByName(
        renamed.select("stream", "seq", F.col("new").alias("path"), F.lit("added").alias("change_kind"))
    )
    plain = diff.join(gone, ["stream", "seq", "path", "change_kind"], "left_anti").select(
        "stream", "file_name", "change_kind", F.col("path").alias("field_name"), F.lit("").alias("new_name")
    )
    named = renamed.join(pairs, ["stream", "seq"]).select(
        "stream", "file_name", F.lit("renamed").alias("change_kind"), F.col("old").alias("field_name"), F.col("new").alias("new_name")
    )
    return plain.unionByName(named)


def _renames(record: DataFrame, diff: DataFrame, order: DataFrame, target: dict[str, str]) -> DataFrame:
    """(stream, seq, old, new): of removed and added fields, those that hold the same values in shared records.

    The fields in play are few beside the records, which are never shuffled whole: they are filtered where they lie, by
    a table that is sent to all executors if it has at most `BROADCAST_ROWS` rows and shuffled beyond.
    """
    both = diff.where("change_kind <> 'retyped'").groupBy("stream", "seq").agg(F.countDistinct("change_kind").alias("k")).where("k = 2").select("stream", "seq")
    moved = diff.join(both, ["stream", "seq"], "left_semi")
    wanted = moved.where("change_kind = 'removed'").select("stream", (F.col("seq") - 1).alias("seq"), "path", F.lit("old").alias("side"), F.col("seq").alias("pair"))
    wanted = wanted.unionByName(moved.where("change_kind = 'added'").select("stream", "seq", "path", F.lit("new").alias("side"), F.col("seq").alias("pair")))
    wanted = stored(wanted.join(order, ["stream", "seq"]).drop("seq"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    sent = F.broadcast(wanted) if few else wanted
    files = wanted.select("stream", "file_name").distinct()
    in_play = record.where("record_key is not null").join(F.broadcast(files) if few else files, ["stream", "file_name"], "left_semi")
    values = (
        _fields(in_play, target)
        .join(sent, ["stream", "file_name", "path"])
        .groupBy("stream", "pair", "record_key", "side", "path")
        .agg(F.min("value").alias("value"))
    )
    o, n = values.where("side = 'old'").alias("o"), values.where("side = 'new'").alias("n")
    same = (
        o.join(n, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in ("stream", "pair", "record_key")])
        .groupBy(F.col("o.stream").alias("stream"), F.col("o.pair").alias("seq"), F.col("o.path").alias("old"), F.col("n.path").alias("new"))
        .agg(F.count_if(F.col("o.value") == F.col("n.value")).alias("same"), F.count(F.lit(1)).alias("shared"))
        .where(F.col("same") >= F.greatest(F.lit(1), SAME_VALUES * F.col("shared")))
    )
    rank = F.struct(F.col("same") / F.col("shared"), "same", "old", "new")
    best = same.withColumn("of_old", F.max(rank).over(Window.partitionBy("stream", "seq", "old"))).withColumn("of_new", F.max(rank).over(Window.partitionBy("stream", "seq", "new")))
    return best.where((F.col("of_old") == rank) & (F.col("of_new") == rank)).select("stream", "seq", "old", "new")


def aliases(found: DataFrame, target: dict[str, str] = TARGET) -> dict[str, tuple[str, list[str]]]:
    """From `changes`: for every target field the names it was renamed to or from, as `promote` takes them.

    Only distinct pairs of field names come to the driver, which the vocabulary of the schemas bounds.
    """
    pairs = {(r[0], r[1]) for r in found.where("change_kind = 'renamed'").select("field_name", "new_name").distinct().collect()}
    out = {}
    for field, kind in target.items():
        names, grown = {field}, True
        while grown:
            more = {b for a, b in pairs if a in names} | {a for a, b in pairs if b in names}
            more -= {n for n in target if n != field}
            grown = not more <= names
            names |= more
        out[field] = (SQL_TYPES[kind], [field, *sorted(names - {field})])
    return out


def consistent_table(lines: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """All records as one table of the target fields, renamed and retyped fields replayed from `rescued`."""
    return promote(ingest(lines, target), aliases(changes(lines, target), target))
