"""Problem 9: mix sources to target weights.

The total is the largest for which every source can give its share of it with no document used more often than the
source allows. A source gives all its documents as often as fits its budget; what is left of the budget is fitted by
subset sums: documents are counted by exact token length, lengths are taken in proportion, and the rest of the budget
is filled by bounded-knapsack dynamic programming over the lengths still there. Which documents of a length are taken
is decided by a seeded hash.

Lengths, not documents, come to one task: a source has at most as many as its longest document has tokens. Documents
of one (source, length) are ranked in `SALTS` parts by hash with offsets, so copies of one text are no hot group.

Documents of sources without a target, and of null source, are left out; so are documents without tokens. A source
without tokens can't give its share: it is reported with 0 and the others keep their ratios. A max_repeats below 1 or
null counts as 0, a null share as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import stored

SEED = 17
SALTS = 256
RELEASE = 8192


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as close to the budget from below as can be."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    exact = counts * (budget / total)
    take = np.minimum(np.floor(exact).astype(np.int64), counts)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(take - exact, kind="stable"):
        if lengths[i] <= left and take[i] < counts[i]:
            take[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        more = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    released = 0
    for i in np.argsort(lengths, kind="stable"):
        give = min(int(take[i]), max(0, (RELEASE - released) // int(lengths[i])), 4)
        take[i] -= give
        released += give * int(lengths[i])
    left += released
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sums up to the budget as bits of an integer; the best sum is traced back through the stages."""
    mask, reach, stages = (1 << (budget + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable"):
        size, n, chunk = int(lengths[i]), int(counts[i]), 1
        n = min(n, budget // size)
        while n > 0:
            part = min(chunk, n)
            stages.append((i, part, reach))
            reach |= (reach << (part * size)) & mask
            n, chunk = n - part, chunk * 2
        if reach >> budget & 1:
            break
    best = reach.bit_length() - 1
    out = np.zeros(len(lengths), np.int64)
    for i, part, before in reversed(stages):
        if not before >> best & 1:
            out[i] += part
            best -= part * int(lengths[i])
    return out


def budgets(sized: DataFrame, targets: DataFrame) -> list[tuple[str, float, int, int, int]]:
    """(source, share, max_repeats, tokens there, budget) per target; there are as many rows as targets."""
    there = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = targets.where("source is not null").join(there, "source", "left").select("source", F.coalesce("target_share", F.lit(0.0)), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)), F.coalesce("tokens", F.lit(0))).collect()
    able = [(s, float(w), int(m), int(t)) for s, w, m, t in rows if w and w > 0 and m and t]
    whole = sum(w for _, w, _, _ in able)
    total = min((m * t / (w / whole) for _, w, m, t in able), default=0.0)
    fitted = {s: min(int(round(w / whole * total)), m * t) for s, w, m, t in able}
    return [(s, float(w or 0), int(m or 0), int(t), fitted.get(s, 0)) for s, w, m, t in sorted(map(tuple, rows))]


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, copies) of (doc_id, source, n_tokens), and the budgets."""
    spark = sized.sparkSession
    sized = stored(sized, "sized")
    plan = budgets(sized, targets)
    planned = spark.createDataFrame([(s, w, m, t, b, b // t if t else 0, b - (b // t) * t if t else 0) for s, w, m, t, b in plan], "source string, target_share double, max_repeats int, available bigint, budget bigint, rounds bigint, rest bigint")
    docs = sized.where("n_tokens > 0 and source is not null").join(F.broadcast(planned.select("source", "rounds", "rest")), "source")
    lengths = docs.groupBy("source", "n_tokens", "rest").agg(F.count(F.lit(1)).alias("n"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n_tokens").reset_index(drop=True)
        group["take"] = fit(group["n_tokens"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["rest"].iloc[0]))
        return group[["source", "n_tokens", "take"]]

    taken = stored(lengths.groupBy("source").applyInPandas(choose, "source string, n_tokens bigint, take bigint"), "taken")
    salted = docs.withColumn("luck", F.xxhash64(F.lit(seed), "doc_id")).withColumn("salt", F.pmod("luck", F.lit(SALTS)))
    part = ["source", "n_tokens", "salt"]
    sizes = salted.groupBy(*part).agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("source", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).join(taken, ["source", "n_tokens"]).select(*part, "offset", "take")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("luck", "doc_id")))
    chosen = ranked.join(offsets, part).withColumn("copies", F.col("rounds") + (F.col("offset") + F.col("rank") <= F.col("take")).cast("bigint"))
    return chosen.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"), planned


def shares(selection: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target: its share, the share reached, tokens and documents selected, the most copies of a document."""
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = planned.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available", "budget", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_copies")]
    )
    whole = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("reached_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
