"""Detectors, forecast, calibration, risk on literal sessions."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminaflow.operators import calibration, cross_session as xs, insights, risk

DAY = dt.datetime(2026, 1, 1)
COLS = "session_id string, start_ts timestamp, signal string, group string, mean double"


def stats(spark, **signals):
    n = max(map(len, signals.values()))
    rows = [(f"s{i:02d}", DAY + dt.timedelta(days=i), k, "oxygen", float(v[i])) for k, v in signals.items() for i in range(min(n, len(v))) if v[i] is not None]
    return spark.createDataFrame(rows, COLS)


def test_trend(spark, heat):
    df = stats(spark, SO1=[0.10 + 0.05 * i for i in range(5)], ST5=[168.0] * 5, NEW=[1.0, 5.0])
    got = xs.signal_trends(df).collect()
    assert [(r.signal, r.direction, r.n_sessions) for r in got] == [("SO1", "increasing", 5)]
    assert got[0].confidence == pytest.approx(min(0.95, 0.35 + 0.4 + got[0].slope_pct_of_mean / 200))


def test_outliers_with_and_without_spread(spark, heat):
    df = stats(spark, A=[1.0, 1.1, 0.9, 1.0, 9.0], B=[2.0, 2.0, 2.0, 2.0, 7.0], C=[3.0] * 5)
    got = {(r.signal, r.session_id): r.z_score for r in xs.session_outliers(df).collect()}
    assert set(got) == {("A", "s04"), ("B", "s04")} and got[("B", "s04")] == pytest.approx(10.0)


def test_before_after_takes_five_each_side(spark, heat):
    vals = [100.0] + [10.0] * 6 + [20.0] * 5 + [500.0]
    df = stats(spark, A=vals)
    ev = spark.createDataFrame([(1, DAY + dt.timedelta(days=7), "filter_replaced"), (2, DAY - dt.timedelta(days=9), "early"), (3, None, "never")], "event_id int, event_ts timestamp, event_type string")
    got = xs.before_after(df, ev).collect()
    assert [(r.event_id, r.before_mean, r.after_mean, r.n_before, r.n_after, r.delta_pct) for r in got] == [(1, 10.0, 20.0, 5, 5, 100.0)]


def brute(values, min_size, jump):
    n, pen = len(values), 3.0 * (float(np.var(values)) or 1e-12)
    grid = [k for k in range(min_size, n) if k % jump == 0]
    sse = lambda a, b: float(((values[a:b] - values[a:b].mean()) ** 2).sum())
    best = None
    for m in range(len(grid) + 1):
        for cuts in itertools.combinations(grid, m):
            edges = [0, *cuts, n]
            if min(b - a for a, b in zip(edges, edges[1:])) < min_size:
                continue
            cost = sum(sse(a, b) for a, b in zip(edges, edges[1:])) + pen * m
            if best is None or cost < best[0] - 1e-9:
                best = (cost, list(cuts))
    return best


def _steps(rng, n):
    level, vals = 0.0, []
    for _ in range(n):
        if rng.random() < 0.25:
            level += rng.choice([-4, 3, 8])
        vals.append(level + rng.gauss(0, 0.4))
    return vals


def _cuts(spark, series, jump, **more):
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k int, i int, v double")
    out = {k: [] for k in series}
    for r in xs.change_points(df, ["k"], ["i"], "v", "i", 2, jump, **more).collect():
        assert r.i == r.pos
        out[r.k].append(r.pos)
    return {k: sorted(v) for k, v in out.items()}


def _cost(v, cuts):
    v, edges = np.array(v), [0, *cuts, len(v)]
    return sum(float(((v[a:b] - v[a:b].mean()) ** 2).sum()) for a, b in zip(edges, edges[1:])) + 3.0 * (float(np.var(v)) or 1e-12) * len(cuts)


@pytest.mark.parametrize("jump", [1, 2, 5])
def test_change_points_are_optimal(spark, heat, jump):
    rng = random.Random(5)
    series = {k: _steps(rng, rng.randint(2, 13)) for k in range(40)}
    for k, cuts in _cuts(spark, series, jump).items():
        assert _cost(series[k], cuts) == pytest.approx(brute(np.array(series[k]), 2, jump)[0])


def test_change_points_of_tiles(spark):
    """A series of several tiles has the cuts that one search finds, at borders too."""
    rng = random.Random(8)
    series = {0: [10.0 * (i // 40) + rng.gauss(0, 0.2) for i in range(200)], 1: [rng.gauss(0, 1) for _ in range(150)], 2: [0.0] * 64 + [9.0] * 64 + [1.0] * 7, 3: [5.0] * 100}
    assert _cuts(spark, series, 1, tile=32) == _cuts(spark, series, 1)
    assert _cuts(spark, series, 1, tile=32)[2] == [64, 128]


def test_shift(spark, heat):
    step = [1.0, 1.02, .98, 1.01, .99, 1.0, 2.0, 2.02, 1.98, 2.01, 2.0, 1.99]
    df = stats(spark, SO1=step, SP4=[1.0 + 0.001 * (i % 2) for i in range(12)], X=[1.0, 9.0, 1.0])
    got = xs.signal_shifts(df).collect()
    assert [(r.signal, r.direction) for r in got] == [("SO1", "up")] and got[0].jump_pct > 50
    exact = xs.signal_shifts(df, jump=1).collect()
    assert [(r.session_index, r.at_session, round(r.level_before, 6), round(r.level_after, 6)) for r in exact] == [(6, "s06", 1.0, 2.0)]


def test_forecast(spark, heat):
    df = stats(spark, up=[1., 2, 3, 4, 5], flat=[5., 5, 5.01, 4.99, 5], away=[9., 8, 7, 6, 5], past=[6., 7, 8, 9, 11], few=[1., 2, 3], free=[1., 2, 3, 4])
    thr = spark.createDataFrame([(k, 10.0, None) for k in ("up", "flat", "away", "past", "few")], "signal string, alarm_high double, alarm_low double")
    got = {r.signal: r.sessions_to_threshold for r in xs.maintenance_forecast(df, thr).collect()}
    assert got == {"up": pytest.approx(5.0), "past": 0.0}


def test_findings_are_one_table(spark):
    df = stats(spark, SO1=[1.0, 1.2, 1.4, 1.6, 1.8, 2.0])
    ev = spark.createDataFrame([(1, DAY + dt.timedelta(days=3), "filter_replaced")], "event_id int, event_ts timestamp, event_type string")
    assert {r.type for r in xs.findings_summary(xs.cross_session_findings(df, ev)).collect()} >= {"trend", "before_after"}


def test_stats_fall_back_to_compact(spark):
    full = stats(spark, A=[1.0])
    got = xs.stats_or_fallback(full, stats(spark, A=[9.0, 2.0])).collect()
    assert {(r.session_id, r["mean"]) for r in got} == {("s00", 1.0), ("s01", 2.0)}


def pairs(spark, spec):
    rec, ses = [], []
    for i, (mat, raw, hours) in enumerate(spec):
        rec.append((i, f"s{i}", mat, raw))
        ses.append((f"s{i}", DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i, hours=hours)))
    return calibration.accuracy_pairs(spark.createDataFrame(rec, "record_id int, session_id string, material string, raw_print_hours double"),
                                      spark.createDataFrame(ses, "session_id string, start_ts timestamp, end_ts timestamp"))


def test_accuracy_and_calibration(spark, heat):
    p = pairs(spark, [("steel", 10.0, 13)] * 3 + [("alu", 2.0, 10)] * 3 + [("ti", 2.0, 4)] * 2 + [("zero", 2.0, 0)])
    assert p.count() == 8 and p.where("material = 'ti'").first().error_pct == -50
    f = calibration.calibration_factors(p)
    cur = spark.createDataFrame([("steel", 1.0)], "material string, factor double")
    got = {r.material: (r.status, r.factor) for r in calibration.recalibrate(f, cur).collect()}
    assert got == {"steel": ("applied", 1.3), "alu": ("out_of_range", None), "ti": ("too_few_pairs", None)}
    assert {r.status for r in calibration.recalibrate(f, cur, locked=True).collect()} == {"locked"}


def test_calibration_uses_the_latest_window(spark, heat):
    p = pairs(spark, [("m", 1.0, 1)] * 30 + [("m", 1.0, 2)] * 20)
    assert calibration.calibration_factors(p).first().suggested_factor == 2.0
    assert calibration.overall_factor(p).first().n_pairs == 50


FEATS = "session_id string, readiness double, anomaly_count double, burn_slope double, data_quality double, o2_mean double, o2_std double, duration_min double, layers double"


def test_heuristic_risk(spark):
    df = spark.createDataFrame([("good", 95., 0., 0., 100., None, None, 60., 50.), ("bad", 20., 6., .8, 40., None, None, 60., 50.), ("bare", None, 0., 0., None, None, None, 0., 0.)], FEATS)
    got = {r.session_id: r for r in risk.heuristic_risk(df).collect()}
    assert got["good"].risk < .3 and got["good"].grade == "low" and got["bad"].risk > .6 and got["bad"].grade == "high"
    assert got["bare"].risk == 0 and got["bare"].top_factors == []
    assert [f.contribution for f in got["bad"].top_factors] == sorted([f.contribution for f in got["bad"].top_factors], reverse=True)


def labelled(spark, n):
    rows = [(f"s{i}", 95. - i % 3 if i % 2 else 30. + i % 3, 0. if i % 2 else 5., .01 * (i % 5), 90., .1 + .01 * i, .01, 60., 50.) for i in range(n)]
    return spark.createDataFrame(rows, FEATS).withColumn("label", F.when(F.col("readiness") < 50, 1).otherwise(0))


def test_training_thresholds_and_order(spark):
    assert risk.train(labelled(spark, 7)) is None
    assert risk.train(labelled(spark, 12).withColumn("label", F.lit(0))) is None
    model = risk.train(labelled(spark, 12))
    assert model.kind == "model" and len(model.features) == 8
    got = {r.session_id: r for r in risk.score(labelled(spark, 12).drop("label"), model).collect()}
    assert got["s0"].risk > .5 > got["s1"].risk and got["s0"].method == "model" and len(got["s0"].top_factors) == 4
    # standardised, L2 with unit strength on the summed loss: the gradient vanishes at the fit
    x = np.array([[got[f"s{i}"][f] for f in model.features] for i in range(12)], dtype=float)
    y = np.array([1.0 if i % 2 == 0 else 0.0 for i in range(12)])
    z = (x - np.array(model.mean)) / np.array(model.scale)
    p = 1 / (1 + np.exp(-(z @ np.array(model.coef) + model.intercept)))
    assert np.abs(z.T @ (p - y) + np.array(model.coef)).max() < 1e-3
    part = labelled(spark, 12).drop("label").withColumn("readiness", F.lit(None).cast("double"))
    assert {r.method for r in risk.score(part, model).collect()} == {"heuristic"}


def test_trees_rank_defects_first(spark):
    data = labelled(spark, 30)
    model = risk.train(data)
    assert model.kind == "trees"
    got = risk.score(data.drop("label"), model).join(data.select("session_id", "label"), "session_id").collect()
    assert min(r.risk for r in got if r.label == 1) > max(r.risk for r in got if r.label == 0)


def test_latest_label_wins(spark):
    df = spark.createDataFrame([("a", "x1", "rejected", DAY), ("a", "x2", " Accepted ", DAY + dt.timedelta(days=1)), ("b", "x3", "брак", DAY), ("c", "x4", "warning", DAY)],
                               "session_id string, outcome_id string, result string, timestamp timestamp")
    assert {r.session_id: r.label for r in risk.latest_labels(df).collect()} == {"a": 0, "b": 1}


def test_print_time_and_cost(spark):
    cols = "layer_count int, hatch_len_mm double, contour_len_mm double, jump_len_mm double, n_jumps int, hatch_speed_mm_s double, contour_speed_mm_s double, jump_speed_mm_s double, jump_delay_ms double, recoat_time_ms double, laser_count int, correction_factor double"
    df = spark.createDataFrame([(100, 1000., 100., 500., 10, 1000., 500., 5000., 1., 9000., 2, 1.5), (100, 1000., 100., 500., 10, None, 500., 5000., 1., 9000., 2, 1.5), (100, 1000., 100., 500., 10, 1000., None, None, None, None, 1, None)], cols)
    a, b, c = calibration.print_time(df).collect()
    scan = (1 + .2 + .1 + .01) * 100 / 2 / 3600
    assert a.raw_print_hours == pytest.approx(scan + .25) and a.print_hours == pytest.approx((scan + .25) * 1.5) and a.time_warnings == []
    assert b.print_hours is None and b.unavailable_reason == "hatch_speed_missing"
    assert c.raw_print_hours == pytest.approx((1 + .1) * 100 / 3600 + 950 / 3600)
    assert c.time_warnings == ["contour_speed_missing", "jump_speed_default", "recoat_time_default"]
    jobs = spark.createDataFrame([(1e6, 2.7, 100., 5., 10., 1000., 100., 300., 10.), (1e6, None, 100., None, 10., 1000., 0., 300., 10.)],
                                 "volume_mm3 double, density_g_cm3 double, powder_cost double, gas_cost_per_atm double, gas_atm_per_print double, filter_cost double, filter_lifetime_hours double, platform_cost double, print_hours double")
    x, y = calibration.cost(jobs).collect()
    assert x.total_cost == pytest.approx(270 + 50 + 100 + 300) and x.cost_warnings == []
    assert y.total_cost == 300 and y.cost_warnings == ["density_missing", "gas_rate_missing", "filter_rate_missing"]


def test_correction_factor(spark):
    df = spark.createDataFrame([({"a": 1.5}, "a", 2.0), ({"a": 1.5}, "b", 2.0), (None, "b", None), ({"b": -1.0}, "b", 2.0)], "m map<string,double>, k string, g double")
    got = [r.f for r in df.select(calibration.correction_factor(F.col("m"), F.col("k"), F.col("g")).alias("f")).collect()]
    assert got == [1.5, 2.0, 1.0, 1.0]


@pytest.mark.parametrize("n,effect,q,pen,counter,want", [(2, .9, .8, 0., 0, ("observation", .25)), (5, 1., 1., 0., 0, ("weak_hypothesis", .55)), (50, .5, .7, .15, 2, ("candidate_insight", .225 + .315 - .31)), (50, 9., 1., 0., 0, ("candidate_insight", .9))])
def test_hypothesis_score(spark, n, effect, q, pen, counter, want):
    s, c = insights.hypothesis_score(F.lit(n), F.lit(effect), F.lit(q), pen, counter)
    r = spark.range(1).select(s.alias("s"), c.alias("c")).first()
    assert (r.s, pytest.approx(r.c)) == want


def test_context_conflicts_and_ages(spark, heat):
    cols = "printer_id string, event_id int, timestamp timestamp, event_type string, material string, powder_batch string, gas_type string, gas_cylinder_id string, value string, unit string, verification_status string"
    h = lambda n: DAY + dt.timedelta(hours=n)
    ev = spark.createDataFrame([
        ("p", 1, h(0), "material_selected", "316L", None, None, None, None, None, "operator_confirmed"), ("p", 2, h(1), "material_selected", "Ti", None, None, None, None, None, "unverified"),
        ("p", 3, h(2), "filter_replaced", None, None, None, None, None, None, "system_matched"), ("p", 4, h(3), "material_selected", "Al", None, None, None, None, None, "operator_confirmed")], cols)
    ch = insights.context_changes(ev)
    assert [(r.value, r.conflict) for r in ch.where("field = 'material'").orderBy("event_id").collect()] == [("316L", False), ("Al", True)]
    ses = spark.createDataFrame([("s0", "p", h(-1)), ("s1", "p", h(2)), ("s2", "p", h(12))], "session_id string, printer_id string, start_ts timestamp")
    got = {r.session_id: (r.material, r.filter_state_age_hours) for r in insights.context_at_start(ses, ev).collect()}
    assert got == {"s0": (None, None), "s1": ("316L", 0.0), "s2": ("Al", 10.0)}


def test_rules_can_be_added(spark):
    rules = insights.default_rules()
    rules.register("long_print", lambda: insights.rule_result(F.col("hours") > 10, "info", F.lit(1.0), F.lit("long")))
    facts = spark.createDataFrame([("a", 3, "m", "b", "c", 11), ("b", 1, None, "b", "", 2)], "session_id string, restart_attempt_count int, material string, powder_batch string, gas_cylinder_id string, hours int")
    got = {(r.session_id, r.rule_id): r.matched for r in rules.run(facts).collect()}
    assert got == {("a", "restart_chain_detected"): True, ("a", "missing_production_context"): False, ("a", "long_print"): True,
                   ("b", "restart_chain_detected"): False, ("b", "missing_production_context"): True, ("b", "long_print"): False}
