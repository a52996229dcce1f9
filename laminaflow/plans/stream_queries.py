"""Streaming forms run over the event table as a file stream; what the watermark has not closed is told apart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laminaflow.plans import adapters as a
from laminaflow.plans.catalog import num, query, ts
from laminaflow.session import shared_dir
from laminaflow.streaming import streams, tail


def _stream(spark, d):
    schema = a.table(spark, d, "events").schema
    raw = streams.read_table_stream(spark, d, schema, "events.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                      F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(f"""WITH {a.EV}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 36 HOUR THEN 1 ELSE 0 END AS f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sn FROM g)
SELECT user_id, {ts('min(ts)')} AS start_ts, {ts('max(ts)')} AS end_ts, count(*) AS events, CAST(max(ts) + INTERVAL 36 HOUR > (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR AS VARCHAR) AS open FROM n GROUP BY user_id, sn""")
def stream_sessions(spark, d):
    closed = streams.drain(streams.stream_sessions(_stream(spark, d), ["user_id"]), "stream-sessions")
    return streams.with_open_sessions(closed, a.events(spark, d), ["user_id"])


@query(f"""WITH {a.EV}, b AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM ev)
SELECT {ts('b')} AS bucket_start, user_id, event_type, min(event_id) AS event_id, {num('max(value)')} AS confidence, count(*) AS copies, CAST(b + INTERVAL 1 HOUR > (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE AS VARCHAR) AS open FROM b GROUP BY b, user_id, event_type""")
def stream_dedup(spark, d):
    ev = _stream(spark, d).withColumn("confidence", F.col("value"))
    closed = streams.drain(streams.stream_dedup(ev, ["user_id", "event_type"], bucket="1 hour"), "stream-dedup")
    whole = a.events(spark, d).withColumn("confidence", F.col("value"))
    return streams.with_open_buckets(closed, whole, ["user_id", "event_type"], "1 hour")


# clocks only, as live frames have them; a source's clock starts again at midnight many times
@query(f"WITH {a.EV} SELECT CAST(user_id AS VARCHAR) AS source, strftime(arg_max(ts, event_id), '%H:%M:%S') AS \"Time\", {num('arg_max(value, event_id)')} AS \"SO1\", max(event_id) AS line_no FROM ev GROUP BY 1")
def live_tail(spark, d):
    frames = _stream(spark, d).select(F.col("user_id").cast("string").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("mtime"),
                                      F.date_format("ts", "HH:mm:ss").alias("Time"), F.col("value").alias("SO1"), F.col("event_id").alias("line_no"))
    return streams.latest_frames(frames, "live-tail").drop("mtime")


# the events as growing log files: lines with a clock only, the last one of a user decides
@query(f"WITH {a.EV}, l AS (SELECT *, user_id % 8 AS f FROM ev) SELECT CAST(f AS VARCHAR) AS machine, strftime(arg_max(ts, event_id), '%H:%M:%S') AS \"Time\", {num('arg_max(value, event_id)')} AS \"SO1\", max(event_id) AS \"ST5\" FROM l GROUP BY 1")
def tail_files(spark, d):
    base = f"{shared_dir(spark).rstrip('/')}/tail-{uuid.uuid4().hex}"
    ev = a.events(spark, d).select((F.col("user_id") % 8).alias("machine"), "event_id", F.concat_ws("|", F.date_format("ts", "HH:mm:ss"), F.col("value").cast("string"), F.col("event_id").cast("string")).alias("value"))
    ev.repartition("machine").sortWithinPartitions("machine", "event_id").select("machine", "value").write.partitionBy("machine").text(base)
    frames = streams.sensor_frames(tail.read_tail(spark, base, ".txt"), ["Time", "SO1", "ST5"])
    found = streams.latest_frames(frames, "tail-files")
    return found.select(F.regexp_extract("source", "machine=([0-9]+)", 1).alias("machine"), "Time", "SO1", F.col("ST5").cast("long").alias("ST5"))


@query(f"WITH {a.RD}, {a.DIM} SELECT idx, session_id, rd.signal, {num('value')} AS value, {num('alarm_low')} AS alarm_low, {num('alarm_high')} AS alarm_high FROM rd JOIN dim USING (signal) WHERE value > alarm_high OR value < alarm_low")
def stream_alarm(spark, d):
    r = _stream(spark, d).select(F.col("event_id").alias("idx"), F.col("user_id").alias("session_id"), F.col("event_type").alias("signal"), "value")
    return streams.drain(streams.reading_alarms(r, a.signal_dim(spark)), "stream-alarm").select("idx", "session_id", "signal", "value", "alarm_low", "alarm_high")


@query(f"""WITH {a.EV}, c AS (SELECT *, lag(event_type) OVER w AS pe, lag(k // 50) OVER w AS pk, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k0 AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS t0 FROM c WHERE rn = 1 OR pe <> event_type OR pk <> k // 50)
SELECT CAST(user_id AS VARCHAR) AS source, event_id AS line_no, {ts('t0')} AS ts_start, {ts('ts')} AS ts_end, pe || ',' || pk AS previous_state, event_type || ',' || (k // 50) AS new_state FROM k0 WHERE rn > 1""")
def stream_transitions(spark, d):
    rows = _stream(spark, d).select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("line_no"), "ts",
                                    F.array(F.col("event_type"), F.floor(F.col("k") / 50).cast("string")).alias("state"))
    return streams.drain(streams.stream_transitions(rows), "stream-transitions")
