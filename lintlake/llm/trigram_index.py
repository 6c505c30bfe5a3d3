"""A stored trigram index: postings of trigrams over chunks of texts, in blocks.

A block is up to `BLOCK` texts of one partition, cut into chunks of `CHUNK` bytes. Its postings, the chunks each
trigram of the vocabulary occurs in, lie beside its first text, so a block is read, intersected and verified by one
task without a shuffle, and blocks are spread over the cluster. The vocabulary holds the trigrams that may be asked
for; a trigram that is asked for later and isn't in it is looked up in the texts of a block when that is searched.

An index lives in a folder. `add` appends blocks, `TrigramIndex(spark, path)` opens what is there, in a later session
too. A match may reach over chunks, so what lets a text through is the union of the postings of its chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lintlake.llm.trigrams import holds, leaves
from lintlake.session import scratch_path, spread

BLOCK = 1024
CHUNK = 16_384
POSTINGS = pa.list_(pa.struct([("gram", pa.string()), ("chunks", pa.list_(pa.int32()))]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: the letters beyond ASCII that an expression without regard to case takes for `s` and `k`
_FOLDED = ("\u017f".encode(), "\u212a".encode())


@lru_cache(4)
def _numbers(vocabulary: tuple[str, ...]) -> np.ndarray:
    """The number of every trigram of a vocabulary at its three bytes, -1 elsewhere."""
    at = np.full(1 << 24, -1, np.int16 if len(vocabulary) < 30_000 else np.int32)
    for k, gram in enumerate(vocabulary):
        a, b, c = gram.encode()
        at[a << 16 | b << 8 | c] = k
    return at


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow array of strings."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _chunks(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each chunk starts, its text) of texts that lie one behind the other."""
    n = np.maximum(-(-np.diff(ends) // CHUNK), 1)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return ends[:-1][text] + nth * CHUNK, text


def postings(ends: np.ndarray, data: np.ndarray, vocabulary: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The chunks of every trigram that occurs, of texts given by the ends of their bytes."""
    starts, text_of = _chunks(ends)
    low = _LOWER[data[ends[0] : ends[-1]]].astype(np.uint32)
    if len(low) < 3:
        return {}
    number = _numbers(vocabulary)[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
    hits = np.flatnonzero(number >= 0)
    chunk = np.searchsorted(starts, hits + ends[0], side="right") - 1
    inside = hits + ends[0] + 2 < ends[1:][text_of[chunk]]
    pairs = np.unique(number[hits][inside].astype(np.int64) * len(starts) + chunk[inside])
    grams, chunks = pairs // len(starts), (pairs % len(starts)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(grams)) + 1
    return {vocabulary[g[0]]: c for g, c in zip(np.split(grams, cuts), np.split(chunks, cuts)) if len(g)}


def _folded(column: pa.Array) -> np.ndarray:
    """Texts with a letter whose case the index doesn't know; they are always let through."""
    ends, data = _bytes(column)
    raw = data[ends[0] : ends[-1]].tobytes()
    out = np.zeros(len(column), bool)
    for letter in _FOLDED:
        at = raw.find(letter)
        while at >= 0:
            text = int(np.searchsorted(ends - ends[0], at, side="right")) - 1
            out[text] = True
            at = raw.find(letter, int(ends[text + 1] - ends[0]))
    return out


class TrigramIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def scratch(cls, spark: SparkSession) -> TrigramIndex:
        """A new index in the shared folder."""
        return cls(spark, scratch_path(spark, "trigrams"))

    def add(self, texts: DataFrame, keys: list[str], column: str, vocabulary: set[str]) -> None:
        """Append texts that are neither null nor empty; the key columns are kept beside them."""
        grams = tuple(sorted(vocabulary))
        rows = texts.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(column).cast("string").alias("text")).where(F.length("text") > 0)
        names = rows.columns

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    ends, data = _bytes(part.column("text"))
                    held = postings(ends, data, grams)
                    listed = pa.array([[{"gram": g, "chunks": c.tolist()} for g, c in held.items()], *[None] * (part.num_rows - 1)], POSTINGS)
                    block = pa.array(np.full(part.num_rows, uuid.uuid4().int >> 65, np.int64))
                    size = pa.array(np.full(part.num_rows, part.num_rows, np.int32))
                    yield pa.RecordBatch.from_arrays([*part.columns, block, size, listed], names=[*names, "block", "size", "postings"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", block bigint, size int, postings array<struct<gram:string,chunks:array<int>>>"
        spread(rows).mapInArrow(build, schema).withColumn("vocabulary", F.when(F.col("postings").isNotNull(), F.array(*map(F.lit, grams)))).write.mode("append").parquet(self.path)

    def search(self, formulas: dict, verify: Callable[[str, list[str]], list[tuple]], keys: list[str], schema: str) -> DataFrame:
        """Rows of `verify(text, names of formulas that let it through)` behind the key columns, which get their names back."""
        table = self.spark.read.parquet(self.path)
        kinds = dict(table.dtypes)
        held_keys = [f"key_{i}" for i in range(len(keys))]
        out_schema = ", ".join(f"{k} {kinds[k]}" for k in held_keys) + ", " + schema
        wanted = tuple(sorted(set().union(*[leaves(f) for f in formulas.values()])))
        fields = self.spark.createDataFrame([], schema).schema
        names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]

        def let_through(texts: pa.Array, listed, known) -> list[list[str]]:
            """The formulas each text of a block meets; `listed` are its postings, None where only a part of it is at hand."""
            ends, data = _bytes(texts)
            ends = ends.copy()
            missing = wanted if listed is None else tuple(sorted(set(wanted) - set(known)))
            n, text_of = len(texts), _chunks(ends)[1]
            lists = {} if listed is None else {p["gram"]: np.array(p["chunks"], int) for p in listed}
            if missing:
                lists |= postings(ends, data, missing)
            held = {}
            for gram, chunks in lists.items():
                held[gram] = np.zeros(n, bool)
                held[gram][text_of[chunks]] = True
            always = _folded(texts)
            out: list[list[str]] = [[] for _ in range(n)]
            for name, formula in formulas.items():
                for i in np.flatnonzero(holds(formula, held, n) | always):
                    out[i].append(name)
            return out

        def judged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            whole = part.column("postings")[0].is_valid and part.column("size")[0].as_py() == part.num_rows
            known = (part.column("postings")[0].as_py(), part.column("vocabulary")[0].as_py()) if whole else (None, None)
            texts, at, rows = part.column("text"), [], []
            for i, names_of in enumerate(let_through(texts, *known)):
                if names_of:
                    found = verify(texts[i].as_py(), names_of)
                    at += [i] * len(found)
                    rows += found
            values = list(zip(*rows)) if rows else [()] * len(names)
            columns = [part.column(k).take(pa.array(at, pa.int64())) for k in held_keys]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(list(v), t) for v, t in zip(values, types)]], names=[*held_keys, *names])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.RecordBatch] = []
            for batch in batches:
                block = batch.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if kept and (a or kept[-1].column("block")[0].as_py() != block[0]):
                        yield judged(kept)
                        kept = []
                    if b > a:
                        kept.append(batch.slice(a, b - a))
            if kept:
                yield judged(kept)

        found = table.mapInArrow(look, out_schema)
        return found.select(*[F.col(h).alias(k) for h, k in zip(held_keys, keys)], *names)
