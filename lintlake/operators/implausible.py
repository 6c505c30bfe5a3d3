"""Problem 6: flag implausible readings of every source relative to its normal behaviour.

A hidden Markov model per source and metric decides. Its states are normal, spike, stuck and out-of-range; the first
three are chains of substates that carry what a flag means: a spike lasts at most `BURST` readings and must return, so
a series can't end in it; a stuck run lasts `RUN` readings at least, each equal to the one before; normal readings
include an excursion of its own, for lasting changes that are no spikes. Emissions are fitted to each source: the range
of the readings around (rolling quantiles), how fast its own tail falls, and how often it repeats a value. They are
fitted again without what the posteriors call spikes or stuck, so neighbouring bursts can't hide each other. A reading's
flag is the state of highest forward-backward probability; hard bounds, which need no neighbours, settle what is
impossible.

A source is cut into stretches of `STRETCH` report intervals with a margin on either side, so no group grows with the
length of a series; rows of a margin are computed twice and reported once. Stretches are streamed through sorted
partitions and the chain runs over many of them at once.

Null readings and zeros are never flagged. Rows without ts are judged by the hard bounds alone and are never grouped.
Null repo, service or window are sources of their own. Deliveries of one report (same source and ts) count once in a
series, by the first that is possible; a delivery that says something else is judged by the same messages in its place.
Integers are read as doubles; NaN and infinities are impossible readings. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 8
BURST = 3
STRETCH = 1500
MARGIN = 200
AROUND = 49
QUANTILE = 0.8
ROUNDS = 4
TOGETHER = 96

#: metric -> (least possible, most possible, smallest range as a share of the median, smallest range)
METRICS = {
    "error_rate": (0.0, 1.0, 0.1, 1e-5),
    "restart_count": (0.0, 10_000.0, 0.0, 2.0),
    "memory_rss_slope": (-1e6, 1e6, 0.05, 0.02),
}
NAMES = np.array(["normal", "spike", "stuck", "out_of_range"])

# Substates: normal, its excursion, the readings of a spike, the readings of a stuck run, out of range.
NORMAL, EXCURSION, SPIKE, STUCK = 0, 1, 2, 2 + BURST
OUT = STUCK + RUN
SIZE = OUT + 1
#: the state of every substate
STATE_OF = np.array([0, 0] + [1] * BURST + [2] * RUN + [3])
# Bounds of what is fitted to a source: how often a normal reading repeats the last, how fast its tail falls.
REPEATS = (0.01, 0.25)
FALL = (1.6, 2.1)
SPREAD = 0.02


def _moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, first and last probabilities of the substates."""
    m = np.zeros((SIZE, SIZE))
    m[NORMAL, [NORMAL, EXCURSION, SPIKE, STUCK, OUT]] = 0.983, 1e-5, 0.006, 0.006, 0.005
    m[EXCURSION, [NORMAL, EXCURSION, STUCK, OUT]] = 0.09, 0.9, 0.005, 0.005
    for k in range(BURST):
        m[SPIKE + k, [NORMAL, OUT]] = 0.95, 0.05
        if k + 1 < BURST:
            m[SPIKE + k, [NORMAL, SPIKE + k + 1]] = 0.9, 0.05
    for k in range(RUN - 1):
        m[STUCK + k, STUCK + k + 1] = 1.0
    m[OUT - 1, [NORMAL, SPIKE, STUCK, OUT - 1, OUT]] = 0.07, 0.01, 0.01, 0.9, 0.01
    m[OUT, [NORMAL, SPIKE, STUCK, OUT]] = 0.56, 0.03, 0.01, 0.4
    first = np.zeros(SIZE)
    first[[NORMAL, EXCURSION, SPIKE, STUCK, OUT]] = 0.97, 1e-5, 0.01, 0.01, 0.01
    last = np.zeros(SIZE)
    last[[NORMAL, EXCURSION, OUT - 1, OUT]] = 1.0
    return m, first, last


MOVES, FIRST, LAST = _moves()


def _ranges(x: np.ndarray, share: np.ndarray, floor: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, width) of the range around the places `at` (series, reading) of padded series; NaN is unknown."""
    half = AROUND // 2
    padded = np.full((x.shape[0], x.shape[1] + 2 * half), np.nan)
    padded[:, half : half + x.shape[1]] = x
    around = np.lib.stride_tricks.sliding_window_view(padded, AROUND, axis=1)
    low, high, middle = (np.full(len(at), np.nan) for _ in range(3))
    for start in range(0, len(at), 20_000):
        part = slice(start, start + 20_000)
        w = np.sort(around[at[part, 0], at[part, 1]], axis=1)
        n = AROUND - np.isnan(w).sum(axis=1)
        row = np.arange(len(w))
        for q, out in ((1 - QUANTILE, low), (QUANTILE, high), (0.5, middle)):
            place = q * np.maximum(n - 1, 0)
            a = np.floor(place).astype(int)
            b = np.minimum(a + 1, np.maximum(n - 1, 0))
            out[part] = np.where(n >= 5, w[row, a] + (w[row, b] - w[row, a]) * (place - a), np.nan)
    width = np.fmax(high - low, np.fmax(share[at[:, 0]] * np.abs(middle), floor[at[:, 0]]))
    return low, high, width


def _far(x: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> np.ndarray:
    """How far readings lie outside a range, in ranges; 0 inside or where nothing is known."""
    with np.errstate(invalid="ignore"):
        far = np.fmax(np.fmax(x - high, low - x), 0) / width
    return np.where(np.isfinite(far), far, 0.0)


def _emissions(x: np.ndarray, far: np.ndarray, same: np.ndarray, repeats: np.ndarray, fall: np.ndarray) -> np.ndarray:
    """Likelihood of readings in every substate; +inf is an impossible reading, NaN (padding) says nothing."""
    e = np.empty((*x.shape, SIZE))
    zero, off, new = x == 0, far > 0, np.where(same, repeats, 1 - repeats)
    e[..., NORMAL] = np.where(zero, 1.0, np.exp(-np.minimum(fall * far, 30.0)) * new)
    outlying = np.where(zero, 0.0, np.where(off, SPREAD * (1 - np.exp(-far)), 1e-9)) * new
    e[..., EXCURSION] = np.where(zero, SPREAD, outlying)
    e[..., SPIKE : SPIKE + BURST] = outlying[..., None]
    e[..., STUCK] = np.where(zero | same, 0.0, 1.0)
    e[..., STUCK + 1 : OUT] = np.where(same, 1.0, 0.0)[..., None]
    e[..., OUT] = 1e-12
    e[np.isinf(x)] = np.where(np.arange(SIZE) == OUT, 1.0, np.where((np.arange(SIZE) == NORMAL) | (np.arange(SIZE) == EXCURSION), 1e-12, 0.0))
    e[np.isnan(x)] = 1.0
    return e


def forward_backward(emission: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what comes before, what comes after) every reading of padded series, each scaled to 1; (series, reading, substate).

    The posterior of a reading is before x emission x after.
    """
    b, n, _ = emission.shape
    before, after = np.empty_like(emission), np.empty_like(emission)
    state = np.tile(FIRST, (b, 1))
    for t in range(n):
        before[:, t] = state
        state = state * emission[:, t]
        state = (state / state.sum(axis=1, keepdims=True)) @ MOVES
    back = np.tile(LAST, (b, 1))
    for t in range(n - 1, -1, -1):
        back = np.where((t >= length - 1)[:, None], LAST, back)
        after[:, t] = back
        back = (emission[:, t] * back) @ MOVES.T
        back = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-300)
    return before, after


def posterior(before: np.ndarray, emission: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probabilities of the four states."""
    p = before * emission * after
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-300)
    return np.stack([p[..., STATE_OF == k].sum(axis=-1) for k in range(4)], axis=-1)


class Chains:
    """The models of many series of readings at once; a reading is finite, or +inf where it is impossible."""

    def __init__(self, series: list[np.ndarray], follows: list[np.ndarray], metrics: list[str]):
        """`follows` says of every reading whether it comes right after the one before, without a null between them."""
        self.length = np.array([len(s) for s in series], int)
        b, n = len(series), int(self.length.max(initial=0))
        self.x = np.full((b, n), np.nan)
        follow = np.zeros((b, n), bool)
        for k, (s, f) in enumerate(zip(series, follows)):
            self.x[k, : len(s)], follow[k, : len(s)] = s, f
        self.share, self.floor = (np.array([METRICS[m][k] for m in metrics]) for k in (2, 3))
        self.same = np.zeros((b, n), bool)
        self.same[:, 1:] = (self.x[:, 1:] == self.x[:, :-1]) & np.isfinite(self.x[:, 1:]) & (self.x[:, 1:] != 0) & follow[:, 1:]
        self.repeats, self.fall = np.full(b, REPEATS[1]), np.full(b, FALL[1])
        self.states = np.zeros((b, n), np.int8)
        self.low, self.high, self.width = (np.full((b, n), np.nan) for _ in range(3))
        self.before, self.after = np.zeros((b, n, SIZE)), np.zeros((b, n, SIZE))
        if b and n:
            self._fit()

    def _fit(self) -> None:
        """Fit emissions and judge, again and again without what was found, until nothing changes."""
        usual = np.isfinite(self.x)
        hidden = np.zeros_like(usual)
        stale, open_ = usual.copy(), np.arange(len(self.x))
        for _ in range(ROUNDS):
            at = np.argwhere(stale)
            places = tuple(at.T)
            self.low[places], self.high[places], self.width[places] = _ranges(np.where(usual & ~hidden, self.x, np.nan), self.share, self.floor, at)
            x, same = self.x[open_], self.same[open_]
            far = _far(x, self.low[open_], self.high[open_], self.width[open_])
            shown = (usual & ~hidden)[open_]
            self.repeats[open_] = np.clip((same & shown).sum(axis=1) / np.maximum(shown.sum(axis=1), 1), *REPEATS)
            tail = shown & (far > 0)
            self.fall[open_] = np.clip(tail.sum(axis=1) / np.maximum((far * tail).sum(axis=1), 1e-9), *FALL)
            e = _emissions(x, far, same, self.repeats[open_, None], self.fall[open_, None])
            before, after = forward_backward(e, self.length[open_])
            self.before[open_], self.after[open_] = before, after
            self.states[open_] = posterior(before, e, after).argmax(axis=-1)
            found = usual & (self.states > 0)
            changed = found != hidden
            if not changed.any():
                break
            hidden, open_ = found, np.flatnonzero(changed.any(axis=1))
            half = AROUND // 2
            count = np.cumsum(np.pad(changed, ((0, 0), (half + 1, half))), axis=1)
            stale = usual & (count[:, AROUND:] - count[:, :-AROUND] > 0 if count.shape[1] > AROUND else changed.any(axis=1, keepdims=True))
        self.states[~np.isfinite(self.x) & ~np.isinf(self.x)] = 0

    def instead(self, k: np.ndarray, t: np.ndarray, value: np.ndarray) -> np.ndarray:
        """States of other finite values in the place of reading t of series k."""
        far = _far(value, self.low[k, t], self.high[k, t], self.width[k, t])
        same = (t > 0) & (value == self.x[k, np.maximum(t - 1, 0)]) & (value != 0)
        e = _emissions(value, far, same, self.repeats[k], self.fall[k])
        return posterior(self.before[k, t], e, self.after[k, t]).argmax(axis=-1)


def states(x: np.ndarray, metric: str) -> np.ndarray:
    """The state of every reading of one series: 0 normal or null, 1 spike, 2 stuck, 3 out of range."""
    least, most, _, _ = METRICS[metric]
    out = np.zeros(len(x), int)
    at = np.flatnonzero(~np.isnan(x))
    value = np.where(np.isinf(x) | (x < least) | (x > most), np.inf, x)[at]
    chains = Chains([value], [np.diff(at, prepend=-1) == 1], [metric])
    out[at] = chains.states[0, : len(at)] if len(at) else 0
    out[at[np.isinf(value)]] = 3
    return out


def _judge(rows: pd.DataFrame) -> pd.DataFrame:
    """(agg_id, metric, state) of whole stretches, sorted by stretch and time; the metrics as `_model_rows` gives them."""
    n = len(rows)
    key = rows["stretch"].to_numpy()
    at = rows["at"].to_numpy()
    new_piece = np.ones(n, bool)
    new_piece[1:] = key[1:] != key[:-1]
    new_report = new_piece.copy()
    new_report[1:] |= at[1:] != at[:-1]
    report, first_of = np.cumsum(new_report) - 1, np.flatnonzero(new_report)
    piece_of = (np.cumsum(new_piece) - 1)[first_of]
    bounds = np.searchsorted(piece_of, np.arange(piece_of[-1] + 2))
    series, follows, metrics, places = [], [], [], []
    values = {}
    for m in METRICS:
        raw = rows[m].to_numpy(dtype=float)
        # The first delivery that is possible speaks for its report, an impossible one where there is none.
        order = np.where(np.isfinite(raw), 0, np.where(np.isinf(raw), 1, 2))
        rank = np.lexsort((np.arange(n), order, report))
        spoken = rank[np.searchsorted(report[rank], np.arange(len(first_of)))]
        one = raw[spoken]
        values[m] = raw
        for a, b in zip(bounds[:-1], bounds[1:]):
            known = np.flatnonzero(~np.isnan(one[a:b]))
            series.append(one[a:b][known])
            follows.append(np.diff(known, prepend=-1) == 1)
            metrics.append(m)
            places.append(a + known)
    ids, names, kinds = [], [], []
    mine, agg = rows["mine"].to_numpy(bool), rows["agg_id"].to_numpy()
    by_size = sorted(range(len(series)), key=lambda k: len(series[k]))
    for start in range(0, len(by_size), TOGETHER):
        part = by_size[start : start + TOGETHER]
        chains = Chains([series[k] for k in part], [follows[k] for k in part], [metrics[k] for k in part])
        for m in METRICS:
            chain, reading = np.full(len(first_of), -1), np.zeros(len(first_of), int)
            for c, k in enumerate(part):
                if metrics[k] == m:
                    chain[places[k]], reading[places[k]] = c, np.arange(len(places[k]))
            raw = values[m]
            row = np.flatnonzero(np.isfinite(raw) & mine & (chain[report] >= 0))
            c, t = chain[report[row]], reading[report[row]]
            state = chains.states[c, t].astype(int)
            other = np.flatnonzero(chains.x[c, t] != raw[row])
            if len(other):
                state[other] = chains.instead(c[other], t[other], raw[row][other])
            hit = (state == 1) | (state == 2)
            ids.append(agg[row[hit]])
            names.append(np.full(int(hit.sum()), m, object))
            kinds.append(NAMES[state[hit]].astype(object))
    return pd.DataFrame({"agg_id": np.concatenate(ids), "metric": np.concatenate(names), "state": np.concatenate(kinds)})


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judge the whole stretches of a sorted partition, some tens of thousands of rows at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < 50_000:
            continue
        rows = pd.concat(held, ignore_index=True)
        key = rows["stretch"].to_numpy()
        cut = int(np.argmax(key == key[-1]))
        held = [rows.iloc[cut:]]
        if cut:
            yield _judge(rows.iloc[:cut])
    if held:
        yield _judge(pd.concat(held, ignore_index=True))


def flags(aggregates: DataFrame) -> DataFrame:
    """(agg_id, metric, state) of every implausible reading."""
    kinds = dict(aggregates.dtypes)
    rows = aggregates.select(
        F.col("agg_id").cast("bigint").alias("agg_id"),
        *["repo", "service", "obs_window"],
        F.unix_micros(F.col("ts").cast("timestamp") if kinds["ts"].startswith("timestamp") else F.to_timestamp("ts")).alias("at"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
    )

    def impossible(m: str):
        # NaN counts as above everything, so it needs no test of its own.
        return (F.col(m) < METRICS[m][0]) | (F.col(m) > METRICS[m][1])

    bounds = F.array_compact(F.array(*[F.when(impossible(m), F.lit(m)) for m in METRICS]))
    broken = rows.select("agg_id", F.explode(bounds).alias("metric"), F.lit(str(NAMES[3])).alias("state"))

    step = F.when(F.lower("obs_window").rlike(r"^\d{1,6}h$"), F.regexp_extract("obs_window", r"\d+", 0).cast("bigint")).otherwise(F.lit(1))
    place = F.floor(F.col("at") / (F.greatest(step, F.lit(1)) * 3_600_000_000))
    own = F.floor(place / STRETCH)
    pieces = F.array_distinct(F.array(own, F.floor((place - MARGIN) / STRETCH), F.floor((place + MARGIN) / STRETCH)))
    source = F.to_json(F.array("repo", "service", "obs_window"))
    cut = (
        rows.where("at is not null")
        .select("agg_id", "at", source.alias("source"), own.alias("own"), F.explode(pieces).alias("piece"), *[F.when(impossible(m), F.lit(float("inf"))).otherwise(F.col(m)).alias(m) for m in METRICS])
        .select("agg_id", "at", F.concat_ws("/", "source", "piece").alias("stretch"), (F.col("own") == F.col("piece")).alias("mine"), *METRICS)
    )
    spark = aggregates.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.repartition(tasks, "stretch").sortWithinPartitions("stretch", "at", "agg_id")
    return broken.unionByName(dealt.mapInPandas(_stream, "agg_id bigint, metric string, state string"))
