from datetime import datetime, timedelta

import numpy as np

from lintlake.operators import implausible
from lintlake.operators.implausible import flags, states

SCHEMA = "agg_id bigint, repo string, service string, obs_window string, ts timestamp, error_rate double, restart_count bigint, memory_rss_slope double, state int"


def series(n=400, seed=1):
    rng = np.random.default_rng(seed)
    return 0.01 + 0.004 * np.sin(np.arange(n) / 24 * 6.28) + rng.normal(0, 0.0005, n)


def test_spikes_levels_and_stuck_values():
    x = series()
    x[100:102] = 0.4
    x[200:] += 0.05
    x[300:310] = 0.0612
    x[50], x[51], x[52], x[53] = np.inf, -0.1, 1.2, np.nan
    got = states(x, "error_rate")
    assert set(np.flatnonzero(got == 1)) == {100, 101}
    assert set(np.flatnonzero(got == 2)) == set(range(300, 310))
    assert set(np.flatnonzero(got == 3)) == {50, 51, 52}
    assert not states(series(60) * 0, "error_rate").any() and len(states(np.zeros(0), "error_rate")) == 0


def test_short_runs_and_long_bursts_are_none():
    x = series()
    x[100:107] = 0.0123
    x[200:206] += 0.3
    assert not (states(x, "error_rate") > 0).any()


def test_runs_of_eight_are_stuck_and_bursts_must_return():
    x = series()
    x[100:108] = 0.0123
    x[398:] = 0.4
    assert set(np.flatnonzero(states(x, "error_rate") > 0)) == set(range(100, 108))
    x[200:203] += 0.3
    assert set(np.flatnonzero(states(x, "error_rate") == 1)) == {200, 201, 202}


def test_the_posteriors_decide(monkeypatch):
    """Flat messages, that is emissions alone, give other flags: repeats of any length, and the end of a series."""
    x = series()
    x[100:107] = 0.0123
    x[200:206] += 0.3
    x[300] = 0.4
    x[-1] = 0.4
    assert set(np.flatnonzero(states(x, "error_rate"))) == {300}
    flat = lambda e, length: (np.ones_like(e), np.ones_like(e))
    monkeypatch.setattr(implausible, "forward_backward", flat)
    assert set(np.flatnonzero(states(x, "error_rate"))) > {101, 200, 205, 300, 399}
    monkeypatch.setattr(implausible, "posterior", lambda before, e, after: np.eye(4)[np.zeros(e.shape[:-1], int)])
    assert not states(x, "error_rate").any()


def test_every_delivery_is_judged(spark):
    x = series(300)
    x[100] = 0.6
    t = datetime(2025, 1, 1)
    rows = [(i, "r", "s", "1h", t + timedelta(hours=i), float(v), 1 + i % 2, float(i % 5), 0) for i, v in enumerate(x)]
    rows += [(900, "r", "s", "1h", t + timedelta(hours=50), 0.55, 1, 0.0, 0), (901, "r", "s", "1h", t + timedelta(hours=100), float(x[99]), 1, 0.0, 0), (902, "r", "s", "1h", t + timedelta(hours=60), 3.0, 1, float("inf"), 0)]
    got = {(r.agg_id, r.metric, r.state) for r in flags(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(100, "error_rate", "spike"), (900, "error_rate", "spike"), (902, "error_rate", "out_of_range"), (902, "memory_rss_slope", "out_of_range")}


def test_flags(spark):
    x = series(300)
    x[100] = 0.6
    t = datetime(2025, 1, 1)
    rows = [(i, "r", "s", "1h", t + timedelta(hours=i), float(v), 2 if i % 3 else 1, 1.0 + i % 5, 0) for i, v in enumerate(x)]
    rows += [(900, "r", "s", "1h", t + timedelta(hours=100), 0.6, 2, 1.0, 0), (901, None, None, None, None, 7.0, -1, None, 0), (902, "r", "q", "1h", t, None, None, float("nan"), 0), (903, "r", "q", "24h", t, 0.0, 0, 0.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.agg_id, r.metric, r.state) for r in flags(df).collect()}
    assert got == {(100, "error_rate", "spike"), (900, "error_rate", "spike"), (901, "error_rate", "out_of_range"), (901, "restart_count", "out_of_range"), (902, "memory_rss_slope", "out_of_range")}
    assert flags(df.limit(0)).count() == 0


def test_stretches_give_the_same_flags(spark, monkeypatch):
    x = series(1200, 3)
    for k in (90, 400, 401, 755, 1100):
        x[k] = 0.5
    x[595:606] = 0.0111
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, "r", "s", "1h", t + timedelta(hours=i), float(v), 1 + i % 2, float(i % 3), 0) for i, v in enumerate(x)], SCHEMA)
    whole = {tuple(r) for r in flags(df).collect()}
    monkeypatch.setattr(implausible, "STRETCH", 300)
    assert {tuple(r) for r in flags(df).collect()} == whole and len(whole) == 16
