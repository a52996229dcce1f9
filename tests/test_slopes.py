"""Theil-Sen over all pairs: counts, narrowing, long keys, against the plain median of pairs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminaflow.operators import slopes


def all_pairs(y):
    i, j = np.triu_indices(len(y), 1)
    return float(np.median((y[j] - y[i]) / (j - i))) if len(y) > 1 else 0.0


def series(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.arange(n)
    return {"noise": rng.normal(size=n) * 5 + 0.01 * x, "steps": np.round(rng.normal(size=n)) * 0.5, "flat with a spike": np.where(x == n // 2, 900.0, 100.0),
            "two levels": np.where(x < n // 2, 0.0, 10.0) + rng.normal(size=n) * 0.01, "line": 3.0 - 0.25 * x, "large": 1e9 + rng.normal(size=n), "heavy": rng.standard_cauchy(n)}[kind]


KINDS = ["noise", "steps", "flat with a spike", "two levels", "line", "large", "heavy"]


@pytest.mark.parametrize("seed", range(5))
def test_inversions(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 17, 100, 257):
        p = rng.permutation(n)
        assert slopes.inversions(p) == sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [2, 3, 50, 51, 1500])
def test_median_slope_by_narrowing(kind, n):
    y = series(kind, n)
    assert slopes.median_slope(y, slopes.Sizes(pairs=1, guide=40, listed=300)) == pytest.approx(all_pairs(y), rel=1e-9, abs=1e-9 * max(1, np.ptp(y)) / n)


def test_a_million_rows_of_one_key():
    y = series("noise", 1_000_000)
    t = slopes.median_slope(y)
    n = len(y)
    # as many slopes below as above, up to those that rounding can't tell from it
    assert abs(slopes.slopes_up_to(y, t) - n * (n - 1) // 4) <= 1000


def test_theil_sen_of_keys(spark):
    rows = [(kind, i, float(v)) for kind in KINDS for i, v in enumerate(series(kind, 90))] + [(None, i, float(i * i)) for i in range(9)] + [("one", 0, 5.0), ("nulls", 0, None)]
    df = spark.createDataFrame(rows, "signal string, i int, v double")
    got = {r.signal: (r.n, r.slope) for r in slopes.theil_sen(df, ["signal"], ["i"], "v").collect()}
    assert got.pop("one") == (1, 0.0) and got.pop(None) == (9, pytest.approx(8.0)) and set(got) == set(KINDS)
    for kind, (n, slope) in got.items():
        assert n == 90 and slope == pytest.approx(all_pairs(series(kind, 90)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("listed", [1 << 19, 50])
def test_long_keys_are_counted_by_chunks(spark, listed):
    sizes = slopes.Sizes(local=100, chunk=64, range=50, guide=40, listed=listed)
    kinds = KINDS if listed > 50 else ["noise", "flat with a spike"]
    rows = [(kind, "m", i, float(v)) for kind in kinds for i, v in enumerate(series(kind, 401))] + [("short", "m", i, float(i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "signal string, machine string, i int, v double").repartition(4)
    got = {r.signal: (r.n, r.slope) for r in slopes.theil_sen(df, ["signal", "machine"], ["i"], "v", sizes=sizes).collect()}
    assert set(got) == {*kinds, "short"}
    for kind in kinds:
        y = series(kind, 401)
        assert got[kind] == (401, pytest.approx(all_pairs(y), rel=1e-9, abs=1e-9 * np.ptp(y) / 401)), kind
    assert got["short"][1] == pytest.approx(all_pairs(np.arange(80) % 7.0))


def test_counts_over_chunks(spark):
    y = series("steps", 200, 3)
    chunks = spark.createDataFrame([("k", c, y[32 * c:32 * c + 32].tobytes()) for c in range(7)], "key string, chunk long, ys binary")
    trials = [-0.5, 0.0, 0.013, 2.0]
    state = spark.createDataFrame([("k", 0, 200, trials, np.arange(0, 200, 9).astype(float).tolist(), y[::9].tolist(), 0.5)], "key string, rank long, n long, trials array<double>, rows_x array<double>, rows_y array<double>, middle double")
    got = {r.t: r["count"] for r in slopes._counts(chunks, state, slopes.Sizes(chunk=32, range=20)).collect()}
    i, j = np.triu_indices(200, 1)
    s = (y[j] - y[i]) / (j - i)
    assert got == {t: int((s <= t).sum()) for t in trials}


def test_one_spike_is_no_trend(spark):
    from laminaflow.operators import cross_session as xs
    rows = [(f"s{i:02d}", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), "SP1", "oxygen", 900.0 if i == 11 else 100.0) for i in range(12)]
    stats = spark.createDataFrame(rows, "session_id string, start_ts timestamp, signal string, group string, mean double")
    limits = spark.createDataFrame([("SP1", 1000.0, 1.0)], "signal string, alarm_high double, alarm_low double")
    assert xs.signal_trends(stats).collect() == [] and xs.maintenance_forecast(stats, limits).collect() == []
