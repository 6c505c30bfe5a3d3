"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter and is read where the work runs."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The key columns and n_tokens, the size of the whole text; null and empty texts have 0."""
    kinds = dict(documents.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            out = batch[keys].copy()
            out["n_tokens"] = [len(encode(t)) if t else 0 for t in batch["_text"]]
            yield out

    kept = spread(documents.select(*keys, F.col(text).alias("_text")))
    return kept.mapInPandas(count, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens bigint")
