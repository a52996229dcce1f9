"""Kernels against plain Python, with and without hot keys."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminaflow.operators import robust
from laminaflow.operators.ordered import Series, group_quantiles


def rows(n=40, seed=1, keys=("a", "b", "c")):
    rng = random.Random(seed)
    out = []
    for i, k in enumerate(keys):
        out += [(k, j, float(rng.randint(0, 30)) if rng.random() > 0.2 else None) for j in range(n // (i + 1))]
    rng.shuffle(out)
    return out


@pytest.fixture
def data(spark):
    raw = rows()
    by = {}
    for k, i, v in sorted(raw, key=lambda r: (r[0], r[1])):
        by.setdefault(k, []).append((i, v))
    return spark.createDataFrame(raw, "k string, i int, v double"), by


def test_series_kernels(data, heat):
    df, by = data
    s = Series(df, ["k"], ["i"])
    assert s.df.where("_cut").isEmpty() == (heat == "cool")
    s = (s.with_row_number("rn").with_count("n").with_running_sum("rs", F.coalesce("v", F.lit(0.0)))
         .with_prev(pv="v").with_next(nv="v").with_last_before(lb="v").with_previous_values("w", "i", 3))
    got = {(r.k, r.i): r for r in s.frame.collect()}
    assert len(got) == sum(map(len, by.values()))
    for k, vals in by.items():
        total, last = 0.0, None
        for p, (i, v) in enumerate(vals):
            r = got[(k, i)]
            total += v or 0.0
            assert (r.rn, r.n, r.rs) == (p + 1, len(vals), pytest.approx(total))
            assert r.pv == (vals[p - 1][1] if p else None)
            assert r.nv == (vals[p + 1][1] if p + 1 < len(vals) else None)
            assert r.lb == last
            assert r.w == [x for x, _ in vals[max(0, p - 3):p]]
            last = v if v is not None else last


def test_null_order_values_sort_first(spark, heat):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 3, 3), ("a", 9, 4), ("a", 7, 5)], "k string, t int, x int")
    got = [r.x for r in Series(df, ["k"], ["t", "x"]).with_row_number("rn").frame.orderBy("rn").collect()]
    assert got == [1, 3, 2, 5, 4]


def test_hot_key_is_cut_into_several_chunks(spark):
    spark.conf.set("spark.laminaflow.hotRows", "100")
    try:
        df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
        s = Series(df, ["k"], ["i"]).with_row_number("rn")
        sizes = [r["count"] for r in s.df.where("k = 0").groupBy("_chunk").count().collect()]
        assert len(sizes) > 20 and max(sizes) < 1000
        assert s.frame.where("k = 0 and rn <> i + 1").count() == 0
    finally:
        spark.conf.set("spark.laminaflow.hotRows", "4000000")


def test_quantiles(data, heat):
    df, by = data
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect()}
    near = {r.k: r.q for r in group_quantiles(df, ["k"], "v", {"q": 0.95}, nearest=True).collect()}
    for k, vals in by.items():
        v = sorted(x for _, x in vals if x is not None)
        assert [got[k].lo, got[k].mid, got[k].hi] == pytest.approx(np.quantile(v, [0.05, 0.5, 0.99]).tolist())
        assert near[k] == v[int(round(0.95 * (len(v) - 1)))]


def spike(values):
    n, med = len(values), statistics.median(values)
    if n < 5:
        return None
    dev = [abs(v - med) for v in values]
    peak = dev.index(max(dev))
    mad = statistics.median(dev)
    if mad > 0:
        return peak, 0.6745 * (values[peak] - med) / mad
    rest = sorted(values, key=lambda v: abs(v - med))[:-1]
    sd = statistics.pstdev(rest)
    if sd > 0:
        return peak, (values[peak] - med) / sd
    return (peak, 99.0) if values[peak] != med else None


def test_robust_spike_branches(spark, heat):
    series = {
        "spread": [1.0, 2.0, 3.0, 4.0, 50.0, 2.5], "flat_one": [9.0] * 7 + [30.0], "flat": [4.0] * 6, "short": [1.0, 2.0, 9.0],
        "mad_zero": [5.0] * 6 + [6.0, 1.0, 9.0], "tie": [0.0, 10.0, 5.0, 5.0, 5.0, 4.0, 6.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {r.k: (r.peak_idx, pytest.approx(r.z_score)) for r in robust.robust_spike(df, ["k"], "i", "v").collect()}
    want = {k: spike(v) for k, v in series.items() if spike(v)}
    assert got == want


def test_theil_sen_and_thinning(spark, heat):
    rng = random.Random(3)
    y = [0.5 * i + rng.gauss(0, 3) for i in range(60)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)] + [("one", 0, 1.0)], "k string, i int, v double")
    got = {r.k: r.slope for r in robust.theil_sen(df, ["k"], ["i"], "v", 2000).collect()}
    pairs = [(y[j] - y[i]) / (j - i) for i in range(60) for j in range(i + 1, 60)]
    assert got["a"] == pytest.approx(statistics.median(pairs)) and got["one"] == 0.0
    row = robust.theil_sen(df, ["k"], ["i"], "v", max_points=25).where("k = 'a'").first()
    thin = row.slope
    assert (row.n, row.n_used) == (60, 25)
    whole = {r.k: (r.n, r.slope) for r in robust.position_slope(df, ["k"], ["i"], "v").collect()}
    assert whole["a"] == (60, pytest.approx(np.polyfit(range(60), y, 1)[0])) and whole["one"] == (1, 0.0)
    pos = np.round(np.linspace(0, 59, 25)).astype(int)
    pairs = [(y[b] - y[a]) / (b - a) for x, a in enumerate(pos) for b in pos[x + 1:]]
    assert thin == pytest.approx(statistics.median(pairs))


@pytest.mark.parametrize("n", [1, 7, 150, 151, 299, 1234])
def test_samples(spark, n):
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"))
    got = sorted(r.i for r in robust.even_sample(df, ["k"], ["i"], 150).collect())
    k = min(150, n)
    assert got == sorted({round(i * (n - 1) / (k - 1)) for i in range(k)} if k > 1 else {0})
    got = sorted(r.i for r in robust.step_sample(df, ["k"], ["i"], 150).collect())
    assert got == (list(range(n)) if n <= 150 else [min(int(i * (n / 150)), n - 1) for i in range(150)])


def test_stride_slope(spark, heat):
    y = [float((i * 7) % 11) + i for i in range(95)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "k string, i int, v double")
    step = 95 // 20
    want = statistics.median([(y[i + step] - y[i]) / step for i in range(0, 95 - step, step)])
    assert robust.stride_slope(df, ["k"], ["i"], "v").first().trend_slope == pytest.approx(want)


def test_rolling_median(spark, heat):
    y = [5.0, 1.0, 9.0, 2.0, 2.0, 7.0, 8.0, 8.0, 1.0, 3.0, 4.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "k string, i int, v double")
    got = [r.baseline for r in robust.rolling_median(df, ["k"], ["i"], "v", 7).orderBy("i").collect()]
    assert got == [statistics.median(y[max(0, i - 7):i]) if i else None for i in range(len(y))]
