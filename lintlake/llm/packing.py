"""Problem 8: fill containers of fixed capacity with documents.

Karmarkar-Karp multiway differencing. Documents are dealt by hash into blocks of about `BLOCK` items, so no block
grows with the data. In a block the windows number at first as many as its tokens need; every item is a partial
partition with one filled window, the two partial partitions with the largest spreads are merged, the fullest window of
one with the emptiest of the other, until one is left: windows of near-equal sums. While its fullest window exceeds the
capacity, the number of windows rises and the block is partitioned again; it starts at what items of that size need at
least and is found in a logarithmic number of rounds.

A document longer than the capacity is split into full pieces, each a container by itself, and a rest that is an item;
no other document is split. Null and empty texts are items of no tokens and lie in a container too. Ties are broken by
the order of doc_id and part, so a result is repeatable.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import stored

CAPACITY = 2048
BLOCK = 4096


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of every item when `sizes` are partitioned into k windows.

    A partial partition is kept as its windows that hold something, by falling sums, so all of them together take no
    more room than the items.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, int)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    made = n
    heap = [(-int(sizes[i]), rank, sizes[i : i + 1].astype(np.int64), np.array([i])) for rank, i in enumerate(np.argsort(-sizes, kind="stable"))]
    count = len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)
        alone, other = len(a) - both, len(b) - both
        sums = np.concatenate([a[:alone], a[alone:] + b[other:][::-1], b[:other]])
        held = np.concatenate([x[:alone], np.arange(made, made + both), y[:other]])
        if both:
            left[made : made + both], right[made : made + both] = x[alone:], y[other:][::-1]
            made += both
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        if len(sums) == k:
            sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), count, sums, held))
        count += 1
    window = np.zeros(n, int)
    stack = [(int(node), w) for w, node in enumerate(heap[0][3])]
    while stack:
        node, w = stack.pop()
        if node < n:
            window[node] = w
        else:
            stack += [(int(left[node]), w), (int(right[node]), w)]
    return window


def least_windows(sizes: np.ndarray, capacity: int) -> int:
    """Windows that are needed at least: by the sum, and as at most d items above capacity / (d + 1) fit into one."""
    big = [-(-int((sizes * (d + 1) > capacity).sum()) // d) for d in range(1, 17)]
    return max(1, -(-int(sizes.sum()) // capacity), *big)


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows that no sum exceeds, as few as differencing finds.

    Their number rises from the least possible, by what is too much and ever faster, and then falls by halves to the
    last that did.
    """
    k, short, step = least_windows(sizes, capacity), 0, 1
    while True:
        found = difference(sizes, k)
        over = np.maximum(np.bincount(found, weights=sizes, minlength=1) - capacity, 0).sum() if len(sizes) else 0
        if not over:
            break
        short, k = k, min(len(sizes), k + max(step, -(-int(over) // capacity)))
        step *= 2
    while short and k - short > 1:
        middle = (short + k) // 2
        window = difference(sizes, middle)
        if np.bincount(window, weights=sizes).max() <= capacity:
            found, k = window, middle
        else:
            short = middle
    return found


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens): documents, those above the capacity cut into full pieces and a rest."""
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("int")
    return sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), full)).alias("part")).select(
        "doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("bigint").alias("n_tokens")
    )


def containers(sized: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, container_id) of (doc_id, n_tokens); start_token counts from 0."""
    items = stored(pieces(sized, capacity), "pieces")
    blocks = max(1, -(-items.count() // block))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "part"]).reset_index(drop=True)
        sizes = group["n_tokens"].to_numpy(np.int64)
        whole = sizes >= capacity
        window = np.empty(len(sizes), np.int64)
        window[~whole] = windows(sizes[~whole], capacity)
        first = int(window[~whole].max()) + 1 if (~whole).any() else 0
        window[whole] = first + np.arange(int(whole.sum()))
        group["container_id"] = group["block"].to_numpy(np.int64) * (1 << 24) + window
        group["start_token"] = group["part"].to_numpy(np.int64) * capacity
        return group[["doc_id", "part", "start_token", "n_tokens", "container_id"]]

    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)))
    spark = sized.sparkSession
    tasks = min(blocks, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(tasks, "block").groupBy("block").applyInPandas(fill, "doc_id bigint, part int, start_token bigint, n_tokens bigint, container_id bigint")


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of capacity left unused."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("held").alias("tokens"),
        F.ceil(F.sum("held") / capacity).alias("least_containers"),
        F.max("held").alias("fullest"),
        (1 - F.sum("held") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
