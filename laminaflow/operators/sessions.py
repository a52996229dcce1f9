"""Idle-gap sessions, session ids, manual corrections and session classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match
from laminaflow.operators.ordered import Series


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], gap: str = "36 hours",
                 name: str = "session_no") -> DataFrame:
    """Numbers the sessions of each key; a new one starts when more than ``gap`` passed since the last row."""
    s = Series(df, keys, [ts, *tie]).with_prev(_before=ts)
    starts = F.col("_before").isNull() | (F.col(ts) > F.col("_before") + F.expr(f"interval {gap}"))
    s = s.with_column("_new", starts.cast("long")).with_running_sum(name, F.col("_new"))
    return s.frame.drop("_before", "_new")


def file_anchor(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """anchor = first stamp in the file, else the day in its name with the clock of mtime, else mtime."""
    first = stamps.where("ts is not null").groupBy("file_id").agg(F.min("ts").alias("_first"))
    clock = F.unix_micros("mtime") - F.unix_micros(F.date_trunc("day", F.col("mtime")))
    named = F.timestamp_micros(F.unix_micros(F.col("name_date").cast("timestamp"))
                               + F.coalesce(F.floor(clock / 1_000_000) * 1_000_000, F.lit(0)))
    out = files.join(first, "file_id", "left")
    return out.withColumn("anchor", F.coalesce("_first", named, F.col("mtime"))).drop("_first")


def session_ids(members: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """One row per (keys, session_no): start, end, deterministic id, grouping confidence.

    The id hashes the sorted member names, so the names of one session meet in one row: its size is the file
    count of a session, not its readings.
    """
    group = [*keys, "session_no"]
    out = members.groupBy(*group).agg(
        F.min("anchor").alias("start_ts"), F.max("anchor").alias("end_ts"),
        F.count(F.lit(1)).alias("file_count"),
        F.array_sort(F.collect_list(name)).alias("_names"), F.collect_set("family").alias("families"))
    digest = F.substring(F.sha2(F.concat_ws("|", "_names"), 256), 1, 8)
    base = F.concat(F.lit("session_"), F.date_format("start_ts", "yyyyMMdd"), F.lit("_"), digest)
    out = out.withColumn("_base", base)
    s = Series(out, [*keys, "_base"], ["start_ts", "session_no"]).with_row_number("_copy")
    sid = F.when(F.col("_copy") == 1, F.col("_base")).otherwise(
        F.concat("_base", F.lit("_"), (F.col("_copy") - 1).cast("string")))
    return s.frame.select(*group, sid.alias("session_id"), "start_ts", "end_ts", "file_count", "families",
                          grouping_confidence(F.col("families")).alias("grouping_confidence"))


def grouping_confidence(families: Column) -> Column:
    # Base confidence and what each family adds.
    points = {"main_event_log": 0.15, "burn_log": 0.20, "stateflow_log": 0.20, "monitor100_log": 0.10}
    score = F.lit(0.35)
    for family, gain in points.items():
        score = score + F.when(F.array_contains(families, family), gain).otherwise(0.0)
    return F.least(score, F.lit(0.95))


def group_files(files: DataFrame, stamps: DataFrame, scope: Sequence[str] = (), gap: str = "36 hours"
                ) -> tuple[DataFrame, DataFrame]:
    """Files -> (file assignment, session table). ``scope`` separates machines."""
    keys = list(scope) or ["_all"]
    anchored = file_anchor(files, stamps)
    if not scope:
        anchored = anchored.withColumn("_all", F.lit(0))
    numbered = gap_sessions(anchored, keys, "anchor", ["name", "file_id"], gap)
    sessions = session_ids(numbered, keys)
    assigned = numbered.join(sessions.select(*keys, "session_no", "session_id"), [*keys, "session_no"])
    starts = numbered.groupBy(*keys, "session_no").agg(F.min(F.struct("anchor", "name", "file_id")).alias("_s"))
    assigned = assigned.join(starts, [*keys, "session_no"])
    opening = F.struct("anchor", "name", "file_id") == F.col("_s")
    reason = F.when(~opening, "temporal_continuity").when(F.col("session_no") > 1, "new_gap_exceeded")
    assigned = assigned.withColumn("reason", reason)
    return assigned.drop("_s", "_all"), sessions.drop("_all")


def manual_split(assigned: DataFrame, moved_paths: DataFrame) -> DataFrame:
    """Files listed in ``moved_paths`` (session_id, path) form part b of their session, the others part a."""
    touched = moved_paths.select("session_id").distinct().withColumn("_touched", F.lit(True))
    moved = moved_paths.select("session_id", "path").distinct().withColumn("_moved", F.lit(True))
    df = assigned.join(touched, "session_id", "left").join(moved, ["session_id", "path"], "left")
    part = F.when(F.col("_moved"), "_b").otherwise("_a")
    sid = F.when(F.col("_touched"), F.concat("session_id", part)).otherwise(F.col("session_id"))
    return df.withColumn("session_id", sid).withColumn(
        "reason", F.when(F.col("_touched"), "manual_split").otherwise(F.col("reason"))).drop("_touched", "_moved")


def manual_merge(sessions: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges`` (session_id, merged_id) joins sessions: earliest start, latest end, confidence 1."""
    df = sessions.join(merges, "session_id", "left")
    gid = F.coalesce("merged_id", "session_id")
    return df.groupBy(gid.alias("session_id")).agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.sum("file_count").alias("file_count"),
        F.when(F.count("merged_id") > 0, 1.0).otherwise(F.max("grouping_confidence")).alias("grouping_confidence"))


def classify_sessions(sessions: DataFrame, files: DataFrame, events: DataFrame, transitions: DataFrame,
                      operator_events: DataFrame) -> DataFrame:
    """Class, confidence and evidence per session from one boolean aggregate per long table.

    files(session_id, family, table_rows), events(session_id, event_type), transitions(session_id, subsystem),
    operator_events(session_id, event_type).
    """
    any_of = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    f = files.groupBy("session_id").agg(
        any_of((F.col("family") == "burn_log") & (F.col("table_rows") > 0)).alias("burn_rows"),
        any_of(F.col("family") == "main_event_log").alias("main_log"),
        F.coalesce(F.bool_and(F.col("family").isin("monitor100_log", "monitor200_log")), F.lit(False)).alias("monitor_only"))
    e = events.groupBy("session_id").agg(
        any_of(F.col("event_type").isin("start", "burn_event", "layer_reference")).alias("layers"),
        any_of(F.col("event_type").isin("restart_attempt", "resume")).alias("restarted"))
    t = transitions.groupBy("session_id").agg(any_of(
        F.col("subsystem").isin("door", "glove", "parameter_check", "heating", "power")).alias("service_state"))
    o = operator_events.groupBy("session_id").agg(any_of(
        F.col("event_type").rlike("^(filter|seal|optics|chamber|calibration|software)_")).alias("service_work"))
    df = sessions.select("session_id").distinct()
    for part in (f, e, t, o):
        df = df.join(part, "session_id", "left")
    df = df.fillna(False)
    printed = F.col("burn_rows") | F.col("layers")
    kinds = [
        (printed & F.col("restarted"), "REAL_PRINT_WITH_RESUME", 0.82, "pause/resume or restart evidence present"),
        (printed, "REAL_PRINT", 0.78, "burn rows or layer references present"),
        (F.col("service_work"), "SERVICE_SESSION", 0.70, "maintenance reported by the operator"),
        (F.col("service_state"), "SERVICE_SESSION", 0.55, "service states without layer-oriented print data"),
        (F.col("monitor_only"), "IDLE_DIAGNOSTIC", 0.50, "monitor activity without print layers"),
        (F.col("main_log"), "PRE_BURN_SESSION", 0.45, "main log without burn or layer data"),
    ]
    pack = lambda c, p, e: F.struct(F.lit(c).alias("classification"), F.lit(p).alias("confidence"),
                                    F.lit(e).alias("evidence"))
    chosen = first_match([(cond, pack(c, p, e)) for cond, c, p, e in kinds],
                         pack("INCOMPLETE_OR_UNKNOWN", 0.20, "insufficient multi-source evidence"))
    return df.withColumn("_k", chosen).select("session_id", "_k.*")
