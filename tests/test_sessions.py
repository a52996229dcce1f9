"""Grouping, classes, features, health and quality on literal rows."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from laminaflow.operators import features, health, quality, sessions, summaries
from laminaflow.sources import logs

T = dt.datetime


def test_files_group_by_gap_with_stable_ids(spark, heat):
    files = [("f1", "a_burn.log", "burn_log", T(2026, 3, 23, 13)), ("f2", "a_time.log", "time_log", T(2026, 3, 23, 13, 5)), ("f3", "b_burn.log", "burn_log", T(2026, 3, 27, 9))]
    def run(rows):
        df = spark.createDataFrame([(i, n, f, m, None) for i, n, f, m in rows], "file_id string, name string, family string, mtime timestamp, name_date date")
        stamps = spark.createDataFrame([], "file_id string, ts timestamp")
        assigned, groups = sessions.group_files(df, stamps)
        return assigned.collect(), groups.orderBy("start_ts").collect()
    assigned, groups = run(files)
    digest = hashlib.sha256("a_burn.log|a_time.log".encode()).hexdigest()[:8]
    assert [g.session_id for g in groups][0] == f"session_20260323_{digest}"
    assert [round(g.grouping_confidence, 2) for g in groups] == [0.55, 0.55]
    assert {r.file_id: r.reason for r in assigned} == {"f1": None, "f2": "temporal_continuity", "f3": "new_gap_exceeded"}
    assert [g.session_id for g in run(files[::-1])[1]] == [g.session_id for g in groups]


def test_anchor_prefers_content_then_name_then_mtime(spark):
    df = spark.createDataFrame([("a", T(2026, 1, 9, 4, 5, 6), dt.date(2026, 1, 2)), ("b", T(2026, 1, 9, 4, 5, 6), dt.date(2026, 1, 2)), ("c", T(2026, 1, 9, 4, 5, 6), None)],
                               "file_id string, mtime timestamp, name_date date")
    stamps = spark.createDataFrame([("a", T(2026, 1, 1)), ("a", T(2026, 1, 3)), ("b", None)], "file_id string, ts timestamp")
    got = {r.file_id: r.anchor for r in sessions.file_anchor(df, stamps).collect()}
    assert got == {"a": T(2026, 1, 1), "b": T(2026, 1, 2, 4, 5, 6), "c": T(2026, 1, 9, 4, 5, 6)}


def test_split_and_merge(spark):
    assigned = spark.createDataFrame([("s", "p1", None), ("s", "p2", None), ("t", "p3", None)], "session_id string, path string, reason string")
    moved = spark.createDataFrame([("s", "p2")], "session_id string, path string")
    got = {r.path: (r.session_id, r.reason) for r in sessions.manual_split(assigned, moved).collect()}
    assert got == {"p1": ("s_a", "manual_split"), "p2": ("s_b", "manual_split"), "p3": ("t", None)}


@pytest.mark.parametrize("clocks,days", [(["23:59:59", "00:00:02"], [0, 1]), (["10:00:00", None, "09:00:00", "23:00:00", "01:00:00", "00:30:00"], [0, None, 0, 0, 1, 1])])
def test_rollover(spark, heat, clocks, days):
    df = spark.createDataFrame([("f", i, T.fromisoformat(f"2026-04-27T{c}") if c else None) for i, c in enumerate(clocks)], "f string, i int, ts timestamp")
    got = [r.ts for r in logs.midnight_rollover(df, ["f"], ["i"]).orderBy("i").collect()]
    assert [None if g is None else (g.date() - dt.date(2026, 4, 27)).days for g in got] == days


def test_classification(spark):
    fam = spark.createDataFrame([("idle", "monitor100_log", 0), ("burn", "burn_log", 1), ("pre", "main_event_log", 0), ("svc", "main_event_log", 0), ("none", "error_log", 0), ("res", "main_event_log", 0)],
                                "session_id string, family string, table_rows int")
    ev = spark.createDataFrame([("res", "start"), ("res", "resume")], "session_id string, event_type string")
    tr = spark.createDataFrame([("svc", "door")], "session_id string, subsystem string")
    op = spark.createDataFrame([("x", "filter_replaced")], "session_id string, event_type string")
    got = {r.session_id: (r.classification, r.confidence) for r in sessions.classify_sessions(fam, fam, ev, tr, op).collect()}
    assert got == {"idle": ("IDLE_DIAGNOSTIC", 0.5), "burn": ("REAL_PRINT", 0.78), "pre": ("PRE_BURN_SESSION", 0.45), "svc": ("SERVICE_SESSION", 0.55),
                   "none": ("INCOMPLETE_OR_UNKNOWN", 0.2), "res": ("REAL_PRINT_WITH_RESUME", 0.82)}


def test_layer_features_skip_missing_durations(spark, heat):
    base = T(2026, 1, 1)
    ev = [("s", l, base + dt.timedelta(seconds=s), "burn") for l, s in [(1, 0), (1, 10), (2, 20), (3, 30), (3, 55)]]
    df = spark.createDataFrame(ev, "session_id string, layer int, ts timestamp, event_type string")
    got = {r.layer: (r.event_count, r.layer_duration_sec, r.delta_from_previous_layer_sec) for r in features.layer_features(df).collect()}
    assert got == {1: (2, 10.0, None), 2: (1, None, None), 3: (2, 25.0, 15.0)}


def test_phase_fallback_to_transitions(spark):
    ev = spark.createDataFrame([("s", 1, T(2026, 1, 1), "log_message", None, None, 0.9)], "session_id string, event_id int, ts timestamp, event_type string, phase string, layer int, confidence double")
    tr = spark.createDataFrame([("s", T(2026, 1, 1), T(2026, 1, 2), "heating"), ("s", T(2026, 1, 1), T(2026, 1, 2), "motion")], "session_id string, ts_start timestamp, ts_end timestamp, subsystem string")
    got = [(r.phase, r.confidence) for r in features.phase_segments(ev, tr, ["event_id"]).collect()]
    assert got == [("heat_up", 0.45)]


def test_burn_times_fall_back_per_session(spark):
    cols = "session_id string, layer int, source_file_id string, source_line int, entry_no int, event_type string, burn_ms long, abs_ms long"
    timing = spark.createDataFrame([
        ("a", 1, "f", 1, 0, "layer_timing_summary", 40218, None), ("a", 1, "f", 2, 0, "layer_timing_summary", 9, None), ("a", 2, "f", 3, 0, "burn_start", None, 5), ("a", 2, "f", 3, 1, "burn_end", None, 95),
        ("b", 1, "f", 1, 0, "burn_start", None, 1000), ("b", 1, "f", 1, 1, "burn_end", None, 4500)], cols)
    rows = spark.createDataFrame([("b", 1, 3.0), ("b", 1, 9.0), ("c", 1, 46800.0), ("c", 1, 46805.0)], "session_id string, layer int, clock_sec double")
    got = {(r.session_id, r.layer): r.duration_sec for r in features.layer_burn_times(timing, rows).collect()}
    assert got == {("a", 1): 40.218, ("b", 1): 3.5, ("c", 1): 5.0}


def test_dedup_keeps_first_with_best_confidence(spark):
    cols = "session_id string, n int, ts timestamp, event_type string, layer int, subsystem string, line_sha string, confidence double"
    ev = spark.createDataFrame([
        ("s", 1, T(2026, 1, 1, 0, 0, 0), "pause", 1, "p", "x", 0.5), ("s", 2, T(2026, 1, 1, 0, 0, 1), "pause", 1, "p", "y", 0.9), ("s", 3, T(2026, 1, 1, 0, 0, 2), "pause", 1, "p", "z", 0.1),
        ("s", 4, None, "pause", None, "p", "same", 0.2), ("s", 5, None, "pause", None, "q", "same", 0.3), ("s", 6, None, "pause", None, "q", "other", 0.3)], cols)
    got = sorted((r.n, r.confidence, r.copies) for r in features.deduplicate(ev, ["n"]).collect())
    assert got == [(1, 0.9, 2), (3, 0.1, 1), (4, 0.3, 2), (6, 0.3, 1)]
    prov = sorted((r.n, r.kept.n) for r in features.dedup_provenance(ev, ["n"]).collect())
    assert prov == [(1, 1), (2, 1), (4, 4), (5, 4)]


def readings(spark, **series):
    rows = [("s", g, f"{g}_{k}", i, float(v)) for k, (g, vs) in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "session_id string, group string, signal string, idx int, value double")


def test_oxygen_spike_is_high(spark):
    got = health.process_anomalies(readings(spark, a=("oxygen", [9] * 7 + [30]), b=("pressure", [1] * 9 + [90]))).collect()
    assert [(r.semantic, r.severity, r.value) for r in got] == [("кислород", "high", 30.0)]


def test_readiness(spark):
    steady = readings(spark, a=("oxygen", [1] * 10), b=("pressure", [2] * 10), c=("humidity", [3] * 10))
    assert health.atmosphere_readiness(steady).first().grade == "good"
    wild = readings(spark, a=("oxygen", [1, 50, 2, 80, 1, 60, 3, 90]), b=("humidity", [3] * 8))
    assert health.atmosphere_readiness(wild).first().score < 75
    assert health.atmosphere_readiness(readings(spark, a=("flow", [1, 2]))).first().grade == "unknown"


def test_burn_drift(spark):
    rows = [("up", i, 10.0 + i) for i in range(1, 12)] + [("flat", i, 10.0) for i in range(30)] + [("flat", 30, 200.0)] + [("one", 1, 5.0)]
    drift, far = health.burn_drift(spark.createDataFrame(rows, "session_id string, layer int, duration_sec double"))
    assert {r.session_id: r.trend for r in drift.collect()} == {"up": "rising", "flat": "rising", "one": "insufficient_data"}
    assert [(r.session_id, r.layer) for r in far.collect()] == [("flat", 30)]


def test_tail_alarm_looks_at_the_end_only(spark, heat):
    limits = spark.createDataFrame([("oxygen", 2.0, None)], "group string, alarm_high double, alarm_low double")
    late = readings(spark, a=("oxygen", [0] * 20 + [5]))
    early = readings(spark, a=("oxygen", [5] + [0] * 20))
    assert health.tail_alarm(late, limits).first().in_alarm is True
    assert health.tail_alarm(early, limits).first().in_alarm is False


def quality_inputs(spark, layers):
    base = T(2026, 1, 1)
    ev = spark.createDataFrame([("s", l, base + dt.timedelta(seconds=l)) for l in layers], "session_id string, layer int, ts timestamp")
    files = spark.createDataFrame([("s", f) for f in ("main_event_log", "sensors_log", "time_log", "monitor100_log")], "session_id string, family string")
    stats = spark.createDataFrame([("s", "SO1", 100, 0.1), ("s", "SO2", 100, 0.2)], "session_id string, signal string, n int, std double")
    return files, ev, ev.select("session_id", "ts"), stats


def test_quality_clean_and_gaps(spark, heat):
    files, ev, st, stats = quality_inputs(spark, range(1, 50))
    issues = quality.session_issues(files, ev, st, stats)
    assert issues.count() == 0 and quality.quality_score(ev, issues).first().score == 100
    files, ev, st, stats = quality_inputs(spark, [l for l in range(1, 50) if not 10 <= l <= 25])
    issues = quality.session_issues(files, ev, st, stats).collect()
    assert [(r.kind, r.severity, r["count"]) for r in issues] == [("layer_gaps", "high", 16)]


def test_sensor_faults_and_time_gaps(spark):
    stats = spark.createDataFrame([("s", "A", 100, 0.0), ("s", "B", 100, 1.0), ("s", "C", 20, 1.0)], "session_id string, signal string, n int, std double")
    assert {r.signal: r.fault for r in quality.sensor_faults(stats).collect()} == {"A": "sensor_stuck", "C": "sensor_dropout"}
    st = spark.createDataFrame([("s", T(2026, 1, 1, h, m)) for h, m in [(0, 0), (0, 10), (3, 0), (3, 45)]], "session_id string, ts timestamp")
    g = quality.time_gaps(st).first()
    assert (g.gaps, g.max_gap_min, g.severity, g.gap_start) == (2, 170.0, "high", T(2026, 1, 1, 0, 10))


def test_missing_families_needs_two(spark):
    files = spark.createDataFrame([("a", "main_event_log"), ("a", "time_log"), ("b", "main_event_log")], "session_id string, family string")
    assert [(r.session_id, r.missing, r.severity) for r in quality.missing_families(files).collect()] == [("a", ["sensors_log"], "medium")]


def test_tolerances_widen(spark):
    df = spark.createDataFrame([("s1", 1, 100.0), ("s2", 2, 120.0), ("s3", 3, 60.0)], "session_id string, n int, x double")
    first = summaries.learn_tolerances(df, ["x"], ["n"])
    assert [(r.min_value, r.max_value) for r in first.collect()] == [(60.0, 120.0)]
    assert [(r.min_value, r.max_value) for r in summaries.learn_tolerances(df.where("n = 1"), ["x"], ["n"]).collect()] == [(95.0, 105.0)]
    more = summaries.learn_tolerances(df.where("n = 1").withColumn("x", F.lit(10.0)), ["x"], ["n"], first)
    assert [(r.min_value, r.max_value) for r in more.collect()] == [(10.0, 120.0)]
    bad = summaries.tolerance_violations(df, summaries.learn_tolerances(df.where("n = 1"), ["x"], ["n"]), ["x"]).collect()
    assert {r.session_id: r.reason for r in bad} == {"s2": "above_learned_tolerance", "s3": "below_learned_tolerance"}
