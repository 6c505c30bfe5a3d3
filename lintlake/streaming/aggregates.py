"""Streams over the same plans as the batch operators: windowed sums, latest record per key, new files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lintlake.operators.aggregates import tumbling
from lintlake.operators.rules import line_findings


def windowed(events: DataFrame, width: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Tumbling sums of a stream of events; rows later than `lateness` are dropped by the watermark."""
    return tumbling(events.withWatermark("ts", lateness), width, keys)


def sessions(events: DataFrame, gap: str, key: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "events")


LATEST = "repo string, commit_sha string, obs_window string, ts timestamp, error_rate double"


def latest_stream(rows: DataFrame) -> DataFrame:
    """An update per (repo, commit, window) whenever a later record than the one kept arrives; the state is one record a key."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for batch in batches:
            for ts, rate in zip(batch["ts"], batch["error_rate"]):
                if pd.notna(ts) and (held is None or ts.value > held[0]):
                    held = (ts.value, None if pd.isna(rate) else float(rate))
        if held is not None:
            state.update(held)
            yield pd.DataFrame({"repo": [key[0]], "commit_sha": [key[1]], "obs_window": [key[2]], "ts": [pd.Timestamp(held[0])], "error_rate": [held[1]]})

    return rows.groupBy("repo", "commit_sha", "obs_window").applyInPandasWithState(keep, LATEST, "at long, error_rate double", "update", GroupStateTimeout.NoTimeout)


def analyse_new_files(files: DataFrame, family: str, sink: str, checkpoint: str):
    """Findings of files as they arrive, as Parquet in a folder per micro-batch; one that is replayed writes its folder anew."""

    def write(batch: DataFrame, number: int) -> None:
        line_findings(batch, family).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
