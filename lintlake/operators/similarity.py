"""Near duplicates by cosine: an exact search in blocks for short lists and by prefix filter among all texts; searches of a query set in blocks against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import cosine
from lintlake.session import stored


def longest(rows: DataFrame, k: int = 200) -> DataFrame:
    """The k longest texts; a top-k is the feature."""
    return rows.orderBy(F.length("text").desc(), "id").limit(k)


def near_duplicates(vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """(id_1, id_2, similarity, severity) of pairs among few vectors, such as `longest` gives."""
    a, b = vectors.alias("a"), vectors.alias("b")
    rows = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), cosine(F.col("a.embedding"), F.col("b.embedding")).alias("similarity"))
    s = F.col("similarity")
    return rows.where(s >= least).withColumn("severity", F.when(s >= 0.95, "HIGH").when(s >= 0.90, "MEDIUM").otherwise("LOW"))


def _severity(s):
    return F.when(s >= 0.95, "HIGH").when(s >= 0.90, "MEDIUM").otherwise("LOW")


def _text_classes(rows: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of texts with a word, and (class_id, size, shingles) of their classes.

    Texts of equal shingles are a class, named by its least id.
    """
    split = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    n = F.size("w")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - words + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, words)))
    texts = rows.select("id", split.alias("w")).where(n > 0).select("id", F.array_sort(F.array_distinct(runs)).alias("shingles"))
    texts = stored(texts.select("id", F.size("shingles").alias("size"), F.xxhash64("shingles").alias("sign"), "shingles"), "texts")
    members = stored(texts.select("id", F.min("id").over(Window.partitionBy("sign", "size")).alias("class_id")), "text_classes")
    firsts = members.where("id = class_id").select("id")
    return members, texts.join(firsts, "id", "left_semi").select(F.col("id").alias("class_id"), "size", "shingles")


def _class_pairs(of: DataFrame, least: float) -> DataFrame:
    """(id_1, id_2, similarity) of all pairs of classes at or above `least`.

    Two sets at cosine t share t² of either, so they meet in the rarest 1 - t² of both (and one more): a prefix filter, which
    loses no pair. Shingles of one class alone come first in that order and are counted, not joined. A shingle at ranks i and
    j leaves room for min(i, j) shared ones up to it and for the shorter rest behind it; pairs for which that is too little go.
    So do pairs of which one's 512-bit map has more bits beyond the other's than may be missing; the rest is compared as sets.
    """
    posts = of.select("class_id", "size", F.explode("shingles").alias("shingle"))
    shared = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = Window.partitionBy("class_id")
    kept = F.col("size") - F.ceil(F.col("size") * least * least - 1e-9) + 1
    rank = F.row_number().over(whole.orderBy("n", "shingle")) + F.col("size") - F.count(F.lit(1)).over(whole)
    prefix = stored(posts.join(shared, "shingle").withColumn("rank", rank).where(F.col("rank") <= kept).select("shingle", "class_id", "size", F.col("rank").cast("int").alias("rank")), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    room = F.least("a.rank", "b.rank") + F.least(F.col("a.size") - F.col("a.rank"), F.col("b.size") - F.col("b.rank"))
    near = room >= least * F.sqrt(F.col("a.size").cast("double") * F.col("b.size")) - 1e-9
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.class_id") < F.col("b.class_id")) & near)
    met = stored(met.select(F.col("a.class_id").alias("id_1"), F.col("b.class_id").alias("id_2")).distinct(), "met")
    bit, word = F.expr("shiftleft(1L, cast(shingle & 63 as int))"), F.expr("shiftright(shingle, 6) & 7")
    maps = stored(posts.groupBy("class_id", "size").agg(*[F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in range(8)]), "maps")
    side = lambda x: maps.select(F.col("class_id").alias(f"id_{x}"), F.col("size").alias(f"size_{x}"), *[F.col(f"m{k}").alias(f"m{k}_{x}") for k in range(8)])
    beyond = lambda x, y: sum((F.bit_count(F.col(f"m{k}_{x}").bitwiseAND(F.bitwise_not(f"m{k}_{y}"))) for k in range(8)), F.lit(0))
    needed = least * F.sqrt(F.col("size_1").cast("double") * F.col("size_2")) - 1e-9
    met = met.join(side(1), "id_1").join(side(2), "id_2").where((beyond(1, 2) <= F.col("size_1") - needed) & (beyond(2, 1) <= F.col("size_2") - needed))
    met = stored(met.select("id_1", "id_2"), "close")
    body = lambda k: of.select(F.col("class_id").alias(f"id_{k}"), F.col("size").alias(f"size_{k}"), F.col("shingles").alias(f"shingles_{k}"))
    s = F.size(F.array_intersect("shingles_1", "shingles_2")) / F.sqrt(F.col("size_1").cast("double") * F.col("size_2"))
    return met.join(body(1), "id_1").join(body(2), "id_2").select("id_1", "id_2", s.alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def similar_texts(rows: DataFrame, least: float = 0.85, words: int = 5) -> DataFrame:
    """(id, class_id, links, similarity, severity) of every text of (id, text) that has a near duplicate among all.

    Texts are vectors of their runs of `words` words. `links` counts the other texts at or above `least`, `similarity` is the
    best of them; `class_id` is the least id of equal vectors, so bulk copies are compared once.
    """
    members, classes = _text_classes(rows, words)
    pairs = stored(_class_pairs(classes, least), "text_pairs")
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.col("id_1").alias("class_id"), F.col("id_2").alias("other"), "similarity").unionByName(pairs.select(F.col("id_2").alias("class_id"), F.col("id_1").alias("other"), "similarity"))
    linked = ends.join(sizes.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("n"), F.max("similarity").alias("best"))
    found = sizes.join(linked, "class_id", "left").select(
        "class_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("similarity")
    )
    return members.join(found.where("links > 0"), "class_id").select("id", "class_id", "links", "similarity", _severity(F.col("similarity")).alias("severity"))


def neighbours(vectors: DataFrame, k: int = 5, modulus: int = 100, block: int = 2048) -> DataFrame:
    """The k nearest of every row whose id is divisible by `modulus`, exactly, against all rows.

    The queries go in blocks of `block` to every partition as one matrix; each partition keeps its own k best, so k
    rows per query and partition are shuffled.
    """
    spark = vectors.sparkSession
    asked = vectors.where(F.col("id") % modulus == 0).select("id", "embedding")
    out = None
    ids = [r[0] for r in asked.select("id").orderBy("id").collect()]
    for at in range(0, max(len(ids), 1), block):
        chunk = asked.where(F.col("id").isin(ids[at : at + block])).orderBy("id").collect() if ids else []
        keys = np.array([r[0] for r in chunk], np.int64)
        q = np.array([r[1] for r in chunk], np.float64) if chunk else np.zeros((0, 1))
        norms = np.linalg.norm(q, axis=1, keepdims=True) if chunk else q
        q = q / np.where(norms > 0, norms, 1)
        shared = spark.sparkContext.broadcast((keys, q))

        def search(batches, shared=shared):
            keys, q = shared.value
            for batch in batches:
                if not len(batch) or not len(keys):
                    continue
                m = np.array(batch["embedding"].tolist(), np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                s = q @ (m / np.where(n > 0, n, 1)).T
                ids = batch["id"].to_numpy(np.int64)
                s[keys[:, None] == ids[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(keys)), top.shape[1])
                found = pd.DataFrame({"query_id": keys[rows], "id": ids[top.ravel()], "similarity": s[rows, top.ravel()]})
                yield found[found["similarity"] > -2]

        part = vectors.select("id", "embedding").mapInPandas(search, "query_id bigint, id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
