"""Problem 5: deduplicate new batches of findings against everything accepted so far.

The metric. A finding is a point (k1, k2, dist): two hashes of its key, which is repository, file, issue type and the
function or variable named in the message, all with their spellings made equal, and its line. The distance of two
points is the sum of the differences of their coordinates, so points of one key are as far apart as their lines and
points of different keys are astronomically far.

There are two fixed pivots, (0, 0, 0) and (`FAR`, 0, 0), whatever the data. The pivot-distance table holds (d1, d2), the
distances of every finding to them, with the point itself, its rule and id. By the triangle inequality two points within
radius r have distances to either pivot at most r apart: the table is joined to a batch on ranges of d1 (cells of width
`CELL`, a point probing one or two) and pruned by d2; what is left is verified by the true distance and the rules. The
batch's own order of arrival is then followed key by key, and its entries are appended.

The leading bits of k1 are those of the repository. The table lies in a folder per batch, its files sorted by k1, and a
batch reads the pages of the ranges of k1 it touches only. The texts of the history are never read again.
The index lives in its folder: `PivotIndex(spark, path)` opens what is there, also in a later session.

Rows that say exactly the same are aggregated before any shuffle by key, so a group of copies of any size is one
entry; entries of one key are bounded by the lines of a file times its rules.

Every row is a point. A null or blank repo, file or issue type, a message that names nothing and a null line are the
same as another such and differ from all others: findings without a line are 0 apart and far from those with one. A null
rule fits any rule. Among several accepted rows that fit, the earliest is named. A null batch_id is batch 0. An empty table gives
an empty result. A batch that is added again under its label is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.paths import BLANKS, with_canonical_path
from lintlake.session import scratch_path

RADIUS = 3
CELL = 8
#: bits of a coordinate that tell keys apart, and above them those of the repository
KEY_BITS, REPO_BITS = 45, 15
FAR = 1 << (KEY_BITS + REPO_BITS)
#: a range of k1 is given by this many of its leading bits
RANGE_BITS = 10
ENTRY = "k1 bigint, k2 bigint, first_id bigint, dist int, rule string, a bigint, d1 bigint, d2 bigint, range int, batch string"


def canonical_rule(rule: Column) -> Column:
    """`sec/SEC-003`, ` SEC_3 ` and `rule:sec003` are all SEC3; a blank rule is missing."""
    r = F.upper(F.regexp_replace(F.regexp_replace(rule, r"^[\s\p{Z}]*(?:[A-Za-z]+[:/])+", ""), r"[\s\p{Z}_\p{Pd}]", ""))
    return F.nullif(F.regexp_replace(r, r"^([A-Z]+)0+(?=\d)", "$1"), F.lit(""))


#: letters, digits and marks of any script, as names are made of
LETTER, WORD = r"\p{L}_$", r"\p{L}\p{N}\p{M}_$"
#: a name in quotes, with its arguments or without; it holds a letter
QUOTED = rf"""['"`’‘“”«‹„‚]([\p{{N}}\p{{M}}.@#:~-]*[{LETTER}][{WORD}.@#:~?!>-]*)(?:\([^()]*\))?['"`’‘“”»›]"""
#: a name called, which plurals as in `file(s)` are not
CALLED = rf"([{LETTER}][{WORD}.]*)\((?!(?:s|es|ies)\))"
#: a word spelled as only code spells it (a_b, aB, $a) that is no part of a path
SPELLED = rf"(?<![{WORD}./\\:@-])((?=\$|_+\p{{L}}|[\p{{L}}\p{{N}}\p{{M}}]+_|\p{{Ll}}[\p{{Ll}}\p{{N}}\p{{M}}]*\p{{Lu}})[{LETTER}][{WORD}]*)(?![{WORD}/\\:@-]|\.[{WORD}])"


def canonical_type(issue_type: Column) -> Column:
    """The letters and digits of an issue type, in upper case; a blank one is missing."""
    return F.nullif(F.upper(F.regexp_replace(issue_type, r"[^\p{L}\p{N}]+", "")), F.lit(""))


def named_symbol(message: Column, issue_type: Column) -> Column:
    """The function or variable a message names, in lower case: quoted, or else called, or else spelled as code and not the issue's type."""
    first = lambda pattern: F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))
    kind = F.coalesce(canonical_type(issue_type), F.lit(""))
    spelled = F.get(F.filter(F.regexp_extract_all(message, F.lit(SPELLED), 1), lambda name: ~canonical_type(name).eqNullSafe(kind)), 0)
    return F.lower(F.coalesce(first(QUOTED), first(CALLED), spelled))


def fingerprints(issues: DataFrame) -> DataFrame:
    """(issue_id, batch_id, k1, k2, dist, rule) of every row; a missing part of the key is a value of its own, and so is a missing line."""
    rows = issues.select(
        F.col("issue_id").cast("bigint").alias("issue_id"),
        F.coalesce(F.col("batch_id"), F.lit(0)).cast("int").alias("batch_id"),
        F.nullif(F.lower(F.trim("repo", F.lit(BLANKS))), F.lit("")).alias("_repo"),
        "file_path",
        canonical_type(F.col("issue_type")).alias("_type"),
        named_symbol(F.col("message"), F.col("issue_type")).alias("_name"),
        F.col("line").cast("int").alias("_line"),
        canonical_rule(F.col("rule_id")).alias("rule"),
    )
    # Keys of rows that miss nothing end with their name, as stored indexes have them.
    parts = [F.concat(F.coalesce(p, F.lit("\u0002")), F.lit("\u0001")) for p in ("_repo", "_path", "_type", "_name")]
    rows = with_canonical_path(rows).withColumn("_key", F.concat(*parts, F.when(F.col("_line").isNull(), "\u0002").otherwise("")))
    bits = lambda h, n: F.shiftrightunsigned(h, 64 - n)
    k1 = F.shiftleft(bits(F.xxhash64("_repo"), REPO_BITS), KEY_BITS) + bits(F.xxhash64("_key"), KEY_BITS)
    k2 = bits(F.xxhash64(F.lit("second"), "_key"), KEY_BITS)
    return rows.select("issue_id", "batch_id", k1.alias("k1"), k2.alias("k2"), F.coalesce("_line", F.lit(0)).alias("dist"), "rule")


def with_pivot_distances(points: DataFrame) -> DataFrame:
    """The points with their distances to the two pivots."""
    rest = F.col("k2") + F.abs(F.col("dist").cast("bigint"))
    return points.withColumns({"d1": F.col("k1") + rest, "d2": F.lit(FAR) - F.col("k1") + rest})


def _range(k1: Column) -> Column:
    return F.shiftright(k1, KEY_BITS + REPO_BITS - RANGE_BITS).cast("int")


def _near(radius: int) -> Column:
    """Pairs of an entry e and a row h of the table that the pivots let through and that are near in truth, of rules that fit."""
    far = lambda c: F.abs(F.col(f"e.{c}") - F.col(f"h.{c}"))
    pruned = (far("d1") <= radius) & (far("d2") <= radius)
    distance = far("k1") + far("k2") + far("dist")
    return pruned & (distance <= radius) & (F.col("e.rule").isNull() | F.col("h.rule").isNull() | (F.col("e.rule") == F.col("h.rule")))


def _in_order(entries: DataFrame, radius: int) -> DataFrame:
    """Resolve entries that repeat no history among themselves, in order of arrival, key by key.

    `entries` are clustered by key and sorted by key and arrival; accepted entries of one key are held by line.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, accepted = None, {}
        for batch in batches:
            named = []
            for k1, k2, first_id, line, rule, a, has in zip(batch["k1"].tolist(), batch["k2"].tolist(), batch["first_id"].tolist(), batch["dist"].tolist(), batch["rule"], batch["a"].tolist(), batch["has"].tolist()):
                if (k1, k2) != key:
                    key, accepted = (k1, k2), {}
                if has:
                    named.append(a)
                    continue
                fits = [i for x in range(line - radius, line + radius + 1) for r, i in accepted.get(x, ()) if rule is None or r is None or r == rule]
                named.append(min(fits) if fits else None)
                if not fits:
                    accepted.setdefault(line, []).append((rule, first_id))
            batch["a"] = pd.array(named, "Int64")
            yield batch.drop(columns="has")

    kept = entries.withColumns({"has": F.col("a").isNotNull(), "a": F.coalesce("a", F.lit(0))})
    return kept.mapInPandas(walk, "k1 bigint, k2 bigint, first_id bigint, dist int, rule string, a bigint")


class PivotIndex:
    """The pivot-distance table of accepted findings in a folder; `add_batch` looks a batch up and appends to it."""

    def __init__(self, spark: SparkSession, path: str, radius: int = RADIUS):
        self.spark, self.path, self.radius = spark, path, radius

    def resolved(self) -> DataFrame:
        """All entries so far: (k1, k2, dist, rule, first_id, a, ...); a is null for accepted entries."""
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def _is_new(self) -> bool:
        try:
            self.resolved()
        except AnalysisException:
            return True
        return False

    def history(self, points: DataFrame, label: str) -> DataFrame:
        """Accepted entries of other batches in the ranges of k1 that a batch touches; their numbers, at most 2 to the `RANGE_BITS`, come to the driver."""
        at = F.explode(F.array_distinct(F.array(_range(F.greatest(F.col("k1") - self.radius, F.lit(0))), _range(F.col("k1") + self.radius))))
        touched = [r[0] for r in points.select(at.alias("range")).distinct().collect()]
        return self.resolved().where(F.col("range").isin(touched) & (F.col("batch") != label) & F.col("a").isNull())

    def add_batch(self, rows: DataFrame, label: str) -> None:
        """Resolve one batch of fingerprints against the table and append its entries."""
        entries = with_pivot_distances(rows.groupBy("k1", "k2", "dist", "rule").agg(F.min("issue_id").alias("first_id")))
        keys = ["k1", "k2", "first_id", "dist", "rule"]
        if self._is_new():
            found = entries.select(*keys, F.lit(None).cast("bigint").alias("a")).repartition("k1", "k2")
        else:
            cells = F.array_distinct(F.array(F.floor((F.col("d1") - self.radius) / CELL), F.floor((F.col("d1") + self.radius) / CELL)))
            probes = entries.withColumn("cell", F.explode(cells)).alias("e")
            held = self.history(rows, label).withColumn("cell", F.floor(F.col("d1") / CELL)).alias("h")
            hits = probes.join(held, (F.col("e.cell") == F.col("h.cell")) & _near(self.radius), "left").select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("h.first_id").alias("a"))
            found = hits.repartition("k1", "k2").groupBy(*keys).agg(F.min("a").alias("a"))
        out = _in_order(found.sortWithinPartitions("k1", "k2", "first_id"), self.radius)
        placed = with_pivot_distances(out).withColumn("range", _range(F.col("k1")))
        placed.write.mode("overwrite").parquet(f"{self.path}/batch={label}")


def repeats(issues: DataFrame, radius: int = RADIUS, index: str | None = None) -> DataFrame:
    """(issue_id_a, issue_id_b) of every row that repeats an accepted one, batch after batch.

    The loop is over batches, of which there are few; each adds its rows to the `PivotIndex` in the folder `index`, or
    to a new one. With an index of earlier runs only new batches need to be given.
    """
    spark = issues.sparkSession
    path = scratch_path(spark, "pivot")
    fingerprints(issues).write.parquet(f"{path}/rows", partitionBy="batch_id")
    batches = sorted(r[0] for r in issues.select(F.coalesce(F.col("batch_id"), F.lit(0)).cast("int").alias("b")).distinct().collect())
    rows = spark.read.schema("issue_id bigint, k1 bigint, k2 bigint, dist int, rule string, batch_id int").parquet(f"{path}/rows")
    table = PivotIndex(spark, index or f"{path}/index", radius)
    for b in batches:
        table.add_batch(rows.where(F.col("batch_id") == b).drop("batch_id"), str(b))
    if table._is_new():
        return rows.select(F.col("issue_id").alias("issue_id_a"), F.col("issue_id").alias("issue_id_b")).limit(0)
    entries = table.resolved().where(F.col("batch").isin([str(b) for b in batches])).withColumn("batch_id", F.col("batch").cast("int"))
    same = ["batch_id", "k1", "k2", "dist"]
    members = rows.alias("r").join(entries.alias("e"), [F.col(f"r.{c}") == F.col(f"e.{c}") for c in same] + [F.col("r.rule").eqNullSafe(F.col("e.rule"))])
    return members.select(F.coalesce("e.a", "e.first_id").alias("issue_id_a"), F.col("r.issue_id").alias("issue_id_b")).where("issue_id_a <> issue_id_b")
