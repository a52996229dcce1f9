"""Linking against brute force."""

import datetime as dt
import random

import pytest

from laminaflow import model
from laminaflow.operators import linking

DAY = dt.datetime(2026, 1, 1)


def make(spark, rec, ses):
    r = spark.createDataFrame([(i, m, None, DAY + dt.timedelta(minutes=t), None, h) for i, m, t, h in rec], "record_id int, m int, printed_at timestamp, created_at timestamp, session_id int, hint_date string")
    s = spark.createDataFrame([(i, m, DAY + dt.timedelta(minutes=t), None) for i, m, t in ses], "session_id int, m int, start_ts timestamp, end_ts timestamp")
    return r, s


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_link_by_time_and_candidates(spark, heat, seed):
    rng = random.Random(seed)
    rec = [(i, rng.randint(0, 2), rng.randint(0, 3000), None) for i in range(40)]
    ses = [(100 + i, rng.randint(0, 2), rng.randint(0, 3000)) for i in range(40)]
    r, s = make(spark, rec, ses)
    near = [(a[0], b[0]) for a in rec for b in ses if a[1] == b[1] and abs(a[2] - b[2]) <= 120]
    lone = {(a, b) for a, b in near if sum(x == a for x, _ in near) == 1 and sum(y == b for _, y in near) == 1}
    assert {(x.record_id, x.session_id) for x in linking.link_by_time(r, s, 2.0, ["m"]).collect()} == lone
    assert sorted((x.record_id, x.session_id) for x in linking.link_candidates(r, s, 2.0, ["m"]).collect()) == sorted(near)


def test_window_ends_are_inclusive(spark):
    r, s = make(spark, [(1, 0, 0, None)], [(2, 0, 120)])
    assert linking.link_by_time(r, s, 2.0).count() == 1
    r, s = make(spark, [(1, 0, 0, None)], [(2, 0, 121)])
    assert linking.link_by_time(r, s, 2.0).count() == 0


def test_hint_runs_first_and_takes_its_session(spark):
    r, s = make(spark, [(1, 0, 10, "2026-01-03"), (2, 0, 2 * 1440, None), (3, 0, 5 * 1440, "2026-01-09")], [(10, 0, 2 * 1440 + 30), (11, 0, 5 * 1440 + 60), (12, 0, 8 * 1440), (13, 0, 8 * 1440 + 5)])
    got = {(x.record_id, x.session_id, x.method) for x in linking.auto_link(r, s, 24.0).collect()}
    assert got == {(1, 10, "hint"), (3, 11, "time")}


@pytest.mark.parametrize("seed,spread", [(1, 60), (2, 12), (3, 3), (4, 200)])
def test_forward_match_equals_taking_turns(spark, heat, seed, spread):
    rng = random.Random(seed)
    recs = [(i, rng.randint(0, 1), rng.randint(0, spread)) for i in range(30)]
    sess = [(100 + i, rng.randint(0, 1), rng.randint(0, spread + 20)) for i in range(25)]
    want, used = {}, set()
    for i, m, d in recs:
        free = sorted((x - d, sid) for sid, sm, x in sess if sm == m and sid not in used and 0 <= x - d <= 10)
        if free:
            want[i] = free[0][1]
            used.add(free[0][1])
    day = lambda d: (DAY + dt.timedelta(days=d)).date()
    r = spark.createDataFrame([(i, m, i, day(d)) for i, m, d in recs], "record_id int, m int, record_no int, record_day date")
    s = spark.createDataFrame([(i, m, day(d)) for i, m, d in sess], "session_id int, m int, session_day date")
    assert {x.record_id: x.session_id for x in linking.link_forward(r, s, 10, ["m"]).collect()} == want


def test_wear(spark):
    s = spark.createDataFrame([(DAY, "REAL_PRINT", 60000.0), (DAY + dt.timedelta(days=2), "REAL_PRINT_WITH_RESUME", 600.0), (None, "REAL_PRINT", 60.0), (DAY + dt.timedelta(days=3), "SERVICE_SESSION", 9e9)],
                              "start_ts timestamp, classification string, duration_min double")
    m = spark.createDataFrame([("hepa_filter", DAY + dt.timedelta(days=1)), ("hepa_filter", DAY - dt.timedelta(days=1))], "component string, timestamp timestamp")
    got = {r.component: (r.used_hours, r.grade) for r in linking.accumulated_since_service(s, m, model.consumable_dimension(spark), model.REAL_PRINT_CLASSES).collect()}
    assert got["hepa_filter"] == (11.0, "ok") and got["recoater_blade"] == (1011.0, "critical") and got["laser_fiber"][1] == "ok"


def test_batch_report(spark):
    b = spark.createDataFrame([("b", "Al", "B1", 50.0, DAY), ("c", "Ti", "B2", 10.0, DAY)], "batch_id string, material string, batch_code string, initial_kg double, created_at timestamp")
    c = spark.createDataFrame([("y1", "b", 4, DAY, [("loaded", 50.0), ("consumed", 10.0)]), ("y2", "b", 7, DAY + dt.timedelta(days=1), [("consumed", 45.0)])],
                              "cycle_id string, batch_id string, reuse_count int, started_at timestamp, history array<struct<event:string,kg:double>>")
    got = {r.batch_id: r for r in linking.batch_report(b, c, linking.history_rows(c)).collect()}
    assert (got["b"].consumed_kg, got["b"].remaining_kg, got["b"].remaining_kg_floor, got["b"].reuse_count, got["b"].quality_pct, got["b"].quality_grade, got["b"].active_cycle) == (55.0, -5.0, 0.0, 7, 44.0, "warning", "y2")
    assert (got["c"].consumed_kg, got["c"].quality_grade, got["c"].active_cycle) == (0.0, "ok", None)


def test_adjacency_null_stamps_make_no_edge(spark, heat):
    df = spark.createDataFrame([("p", 1, None, "m", "a"), ("p", 2, DAY, "operator_event", "b"), ("p", 3, DAY + dt.timedelta(minutes=30), "anomaly", "c"), ("p", 4, DAY + dt.timedelta(hours=9), "m", "d")],
                               "p string, id int, ts timestamp, kind string, event_type string")
    got = [(r.source, r.target, r.relationship) for r in linking.time_adjacency(df, ["p"], ["id"]).orderBy("source").collect()]
    assert got == [(2, 3, "temporally_near"), (3, 4, "precedes")]


def test_overlay_null_preset_keeps_global(spark):
    p = spark.createDataFrame([("AlSi10Mg", 1000.0, 50.0), ("Ti", 900.0, None)], "material string, hatch_speed_mm_s double, jump_delay_ms double")
    q = spark.createDataFrame([(2, "AlSi10mg", True, 7.0, 7.0), (1, "alsi10mg", True, 1200.0, None), (3, "Ti", False, 1.0, 1.0)],
                              "preset_id int, material string, is_default boolean, hatch_speed_mm_s double, jump_delay_ms double")
    got = {r.material: (r.hatch_speed_mm_s, r.jump_delay_ms, r.preset_used) for r in linking.overlay_params(p, q, ["hatch_speed_mm_s", "jump_delay_ms"]).collect()}
    assert linking.overlay_params(p, q, ["hatch_speed_mm_s", "jump_delay_ms"]).count() == 2
    assert got == {"AlSi10Mg": (1200.0, 50.0, True), "Ti": (900.0, None, False)}
