"""Write side, structured queries, streams against their batch forms."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from laminaflow.operators import features
from laminaflow.operators.query import QuerySpec, run_query
from laminaflow.sources import logs, sinks
from laminaflow.streaming import streams, tail

T0 = dt.datetime(2026, 1, 1)


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([(k, p, v, T0 + dt.timedelta(hours=h), x) for k, p, v, h, x in r], "k int, p string, v string, at timestamp, x double")
    for _ in range(2):
        sinks.upsert(spark, path, rows((1, "a", "old", 0, 1.0), (2, "b", "two", 0, float("nan"))), ["k", "p"], F.col("at"), "p")
    sinks.upsert(spark, path, rows((1, "a", "new", 1, float("inf")), (3, "a", "three", 1, 2.0)), ["k", "p"], F.col("at"), "p")
    sinks.upsert(spark, path, rows((1, "a", "stale", 0, 9.0)), ["k", "p"], F.col("at"), "p")
    got = sorted((r.k, r.p, r.v, r.x) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a", "new", None), (2, "b", "two", None), (3, "a", "three", 2.0)]


def test_upsert_keeps_columns_and_takes_new_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    at = lambda h: T0 + dt.timedelta(hours=h)
    sinks.upsert(spark, path, spark.createDataFrame([(1, "a", "n1", at(0)), (2, "b", "n2", at(0))], "id int, v string, note string, at timestamp"), ["id"], F.col("at"))
    sinks.upsert(spark, path, spark.createDataFrame([(1, "new", at(1)), (3, "c", at(1))], "id int, v string, at timestamp"), ["id"], F.col("at"))
    sinks.upsert(spark, path, spark.createDataFrame([(2, "b2", 7, at(2))], "id int, v string, extra int, at timestamp"), ["id"], F.col("at"))
    got = sorted((r.id, r.v, r.note, r.extra) for r in spark.read.parquet(path).collect())
    assert got == [(1, "new", "n1", None), (2, "b2", "n2", 7), (3, "c", None, None)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_first_import_wins_for_times(spark):
    s = "session_id string, start_ts timestamp, end_ts timestamp, payload string"
    old = spark.createDataFrame([("a", T0, None, "p0"), ("b", T0, T0, "p0")], s)
    new = spark.createDataFrame([("a", T0 + dt.timedelta(1), T0 + dt.timedelta(2), "p1"), ("c", T0, T0, "p1")], s)
    got = {r.session_id: (r.start_ts.day, r.end_ts.day, r.payload) for r in sinks.merge_sessions(old, new).collect()}
    assert got == {"a": (1, 3, "p1"), "b": (1, 1, "p0"), "c": (1, 1, "p1")}


def test_export_by_category(spark, tmp_path):
    t = {"sessions": spark.range(2), "operator_events": spark.range(3), "not_listed": spark.range(1)}
    assert sinks.export_tables(t, str(tmp_path), ["sessions"]) == ["sessions/sessions"]
    assert sorted(sinks.export_tables(t, str(tmp_path), ["nope"])) == ["operator/operator_events", "sessions/sessions"]
    assert spark.read.json(str(tmp_path / "operator/operator_events")).count() == 3


def test_reports_keep_order(spark, tmp_path, heat):
    ev = spark.createDataFrame([("s", i, T0 + dt.timedelta(seconds=i), "pause") for i in range(12)], "session_id string, event_id int, ts timestamp, event_type string")
    cls = spark.createDataFrame([("s", "REAL_PRINT", .78)], "session_id string, classification string, confidence double")
    rows = sinks.report_rows({"session_summary": (cls, ["classification"]), "timeline": (ev, ["ts", "event_id"])}, {"analysis": "0.1"})
    got = [(r.section, r.position) for r in rows.orderBy("section_no", "position").collect()]
    assert got == [("session_summary", 1)] + [("timeline", i) for i in range(1, 13)] + [("version_metadata", 1)]
    sinks.write_reports(rows, str(tmp_path / "r"), "body", 2)
    assert spark.read.text(str(tmp_path / "r")).count() == 14


def test_backfill_dry_run_writes_nothing(spark, tmp_path):
    ses = spark.createDataFrame([("a", T0, T0, "f"), ("b", T0, T0, None), ("c", T0, T0, "f")], "session_id string, start_ts timestamp, end_ts timestamp, features string")
    spans = spark.createDataFrame([("a", T0, T0), ("c", T0, T0 + dt.timedelta(1))], "session_id string, span_start timestamp, span_end timestamp")
    redo = lambda ids: ids.select("session_id", F.lit(T0).alias("start_ts"), F.lit(T0 + dt.timedelta(1)).alias("end_ts"))
    got = {r.session_id: r.reason for r in sinks.backfill(spark, ses, spans, redo, str(tmp_path / "x")).collect()}
    assert got == {"b": "missing_features", "c": "stale_span"} and not (tmp_path / "x").exists()
    sinks.backfill(spark, ses, spans, redo, str(tmp_path / "x"), dry_run=False)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2


def entity(spark):
    return {"sessions": spark.createDataFrame([(i, f"Name{i}", T0 + dt.timedelta(days=i), '{"runtime_payload":{"group":{"features":{"material":"m%d","duration_sec":%d}}}}' % (i % 2, i)) for i in range(10)],
                                              "session_id int, name string, start_ts timestamp, context string")}


@pytest.mark.parametrize("op,value,n", [("eq", 3, 1), ("gt", 3, 6), ("gte", 3, 7), ("lt", 3, 3), ("lte", 3, 4), ("between", [2, 5], 4), ("in", [1, 99], 1)])
def test_query_operators(spark, op, value, n):
    q = QuerySpec("sessions", "count", filters=[{"field": "session_id", "operator": op, "value": value}])
    assert run_query(q, entity(spark)).first().result == n


def test_query_context_time_and_errors(spark):
    e = entity(spark)
    as_of = F.lit(T0 + dt.timedelta(days=9)).cast("timestamp")
    run = lambda **k: run_query(QuerySpec("sessions", **k), e, as_of)
    assert [(r.value, r["count"]) for r in run(action="group_by", group_by="material").collect()] == [("m0", 5), ("m1", 5)]
    assert run(action="sum", field="duration_sec").first().result == 45.0
    assert run(action="count", filters=[{"field": "days", "operator": "in_last_n", "value": 3}]).first().result == 4
    assert run(action="count", filters=[{"field": "name", "operator": "contains", "value": "NAME1"}]).first().result == 1
    assert [r.session_id for r in run(order_by="start_ts", order_dir="desc", limit=2, offset=1, select=["session_id", "material"]).collect()] == [8, 7]
    with pytest.warns(UserWarning):
        assert run(action="count", filters=[{"field": "zzz", "operator": "eq", "value": 1}]).first().result == 10
    with pytest.warns(UserWarning):
        assert run(action="count", filters=[{"field": "name", "operator": "like", "value": 1}]).first().result == 10
    for bad in (dict(action="median"), dict(action="sum"), dict(action="group_by")):
        with pytest.raises(ValueError):
            run(**bad)


def feed(spark, tmp_path, frames):
    path = str(tmp_path / "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return streams.read_table_stream(spark, path, frames[0].schema, files_per_trigger=1)


def test_transitions_over_micro_batches_equal_batch(spark, tmp_path):
    import time
    stamps = [(22, 0, "a"), (23, 0, "a"), (23, 59, "b"), (0, 5, "b"), (1, 0, "c"), (2, 0, "c"), (3, 0, "a"), (4, 0, None)]
    rows = [("f", i, T0.replace(hour=h, minute=m), [s, "0"]) for i, (h, m, s) in enumerate(stamps)]
    schema = "source string, line_no long, ts timestamp, state array<string>"
    frames = []
    for i in range(0, len(rows), 3):
        frames.append(spark.createDataFrame(rows[i:i + 3], schema))
    path = str(tmp_path / "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source takes files in order of modification time
    src = streams.read_table_stream(spark, path, frames[0].schema, files_per_trigger=1)
    got = sorted((r.line_no, r.ts_start, r.ts_end, r.new_state) for r in streams.drain(streams.stream_transitions(src), "t").collect())
    whole = spark.createDataFrame(rows, schema).withColumn("columns", F.array(F.lit("x"), F.lit("y")))
    rolled = logs.midnight_rollover(whole, ["source"], ["line_no"])
    want = sorted((r.line_no, r.ts_start, r.ts_end) for r in logs.state_transitions(rolled, ["source"], ["line_no"]).collect())
    assert [g[:3] for g in got] == want and [g[3][0] for g in got] == ["b", "c", "a", None]
    assert got[1][1] == T0.replace(hour=23, minute=59) and got[1][2] == T0 + dt.timedelta(days=1, hours=1)


def test_stream_dedup_equals_batch_on_closed_buckets(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=i // 3), "pause", "p", .1 * i) for i in range(30)] + [(99, T0 + dt.timedelta(hours=2), "pause", "p", 0.0)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string, subsystem string, confidence double")
    got = {r.event_id: r.copies for r in streams.drain(streams.stream_dedup(feed(spark, tmp_path, [df]), ["event_type", "subsystem"]), "d").collect()}
    batch = features.deduplicate(df.withColumn("session_id", F.lit("s")).withColumn("layer", F.lit(1)).withColumn("line_sha", F.lit("")), ["event_id"])
    assert got == {r.event_id: r.copies for r in batch.where("event_id <> 99").collect()}


def test_live_frames(spark):
    src = spark.createDataFrame([("f", T0, k, l) for k, l in enumerate(("Time|SO1|ST5|", "10:00:00|1,5|150|", "10:00:02|2.5|150|", "bad", "10:00:01||210|"))],
                                "source string, mtime timestamp, line_no int, line string")
    frames = streams.sensor_frames(src, ["Time", "SO1", "ST5"])
    assert frames.count() == 3
    assert {r.Time: r.alarm for r in streams.live_alarm(frames, 2.0, 200.0).collect()} == {"10:00:00": False, "10:00:02": True, "10:00:01": True}
    assert streams.live_tail(frames).first().Time == "10:00:01"  # the last line, whatever its clock


def test_live_tail_over_midnight(spark):
    rows = lambda *clocks: spark.createDataFrame([("f", T0, k, c) for k, c in enumerate(clocks)], "source string, mtime timestamp, line_no int, Time string")
    for clocks in (("23:59:58", "00:00:02"), ("00:00:02", "11:00:00", "23:59:58"), ("10:00:00", "09:59:00"), [f"{h % 24:02d}:00:00" for h in range(20, 38)]):
        assert streams.live_tail(rows(*clocks)).first().Time == clocks[-1]
    with pytest.raises(ValueError):
        streams.live_tail(rows("10:00:00").drop("line_no"))


def test_tail_reads_appended_bytes_only(tmp_path, monkeypatch):
    """Ranges cover each whole line once, whatever their size; a second batch reads what was appended, a shorter file anew."""
    log = tmp_path / "a.log"
    lines = [("x" * (7 * k % 23)) for k in range(60)]
    log.write_text("\n".join(lines) + "\nunfinished")
    for size in (1, 5, 64, 1 << 20):
        reader = tail.TailReader({"path": str(tmp_path), "rangeBytes": str(size)})
        start, end = reader.initialOffset(), reader.latestOffset()
        got = [r for p in reader.partitions(start, end) for r in reader.read(p)]
        assert [r[4] for r in got] == lines and [r[3] for r in got] == [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    with log.open("a") as f:
        f.write(" line\nnext\nopen")
    (tmp_path / "b.log").write_text("other\n")
    more = reader.latestOffset()
    parts = reader.partitions(end, more)
    assert sum(p.stop - p.start for p in parts) == len("unfinished line\nnext\n") + len("other\n")
    assert [r[4] for p in parts for r in reader.read(p)] == ["unfinished line", "next", "other"]
    assert reader.partitions(more, reader.latestOffset()) == []
    log.write_text("new\n")
    assert [(r[2], r[4]) for p in reader.partitions(more, reader.latestOffset()) for r in reader.read(p)] == [(1, "new")]
    fresh = tail.TailReader({"path": str(tmp_path)})  # after a restart
    assert [r[4] for p in fresh.partitions(more, fresh.latestOffset()) for r in fresh.read(p)] == ["new"]


def test_tail_stream_follows_growing_files(spark, tmp_path):
    folder, state, out = tmp_path / "logs", tmp_path / "state", tmp_path / "out"
    folder.mkdir()
    header = ["Time", "SO1", "ST5"]

    def run():
        frames = streams.sensor_frames(tail.read_tail(spark, str(folder), ".log"), header)
        query = frames.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(out))

    log = folder / "night.log"
    log.write_text("Time|SO1|ST5|\n" + "".join(f"{h:02d}:00:00|{h}|150|\n" for h in range(20, 24)) + "00:00:00|0|1")
    assert run().count() == 4
    with log.open("a") as f:
        f.write("50|\n" + "".join(f"{h:02d}:00:00|{h}|150|\n" for h in range(1, 14)))
    whole = run()
    assert whole.count() == 18 and streams.live_tail(whole).first().Time == "13:00:00"


def test_tail_follows_a_growing_file(spark, tmp_path):
    log = tmp_path / "x.log"
    log.write_text("one\ntwo\n")
    lines, seen = streams.tail_lines(spark, str(tmp_path))
    assert sorted(r.line for r in lines.collect()) == ["one", "two"]
    with log.open("a") as f:
        f.write("three\n")
    lines, again = streams.tail_lines(spark, str(tmp_path), seen)
    assert [r.line for r in lines.collect()] == ["three"] and again.first().upto == 14
    log.write_text("new\n")
    assert [r.line for r in streams.tail_lines(spark, str(tmp_path), again)[0].collect()] == ["new"]


def test_workers_get_the_package(tmp_path):
    """Python in an empty folder, without PYTHONPATH, with the package imported by its path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from laminaflow.plans import QUERIES
from laminaflow.session import build_session
from laminaflow.sources.files import list_files
spark = build_session(master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
for name in ("signal_shifts", "stream_transitions"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
assert list_files(spark, "/root/testdata").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_hand_over_once_per_row(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "session_id string")
    src, seen = feed(spark, tmp_path, [df]), []
    ck = str(tmp_path / "ck")
    for _ in range(2):
        streams.recompute_changed(src, ck, lambda ids: seen.append(sorted(r.session_id for r in ids.collect()))).awaitTermination()
    assert seen == [["a", "b"]]


def test_liveness_announces_a_source_once(spark, tmp_path):
    df = spark.createDataFrame([("f1",), ("f2",), ("f1",)], "source string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    got = []
    # timers keep a processing-time query alive, so it is stopped from outside
    query = streams.source_liveness(feed(spark, tmp_path, [df]), 3600).writeStream.foreachBatch(
        lambda b, _: got.extend((r.source, r.status) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(60):
        if len(got) >= 2 or query.exception():
            break
        query.awaitTermination(1)
    query.stop()
    assert sorted(got) == [("f1", "live"), ("f2", "live")]
