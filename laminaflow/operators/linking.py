"""Joins between records, sessions, events and parameters."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminaflow.functions.scalars import first_match, seconds_between
from laminaflow.model import PRESET_COLUMNS, REQUIRED_PARAMS
from laminaflow.operators.ordered import Series
from laminaflow.session import materialize


def last_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` sessions with a start (a top-n, resolved without a full sort)."""
    return sessions.where("start_ts is not null").orderBy(F.desc("start_ts"), "session_id").limit(n)


def in_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the given sessions; no sessions means no rows."""
    return rows.join(sessions.select("session_id"), "session_id", "left_semi")


def unclaimed(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Sessions with a start that no record has claimed yet."""
    taken = records.where("session_id is not null").select("session_id")
    return sessions.where("start_ts is not null").join(taken, "session_id", "left_anti")


def time_neighbours(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, before: float, after: float,
                    on: Sequence[str] = ()) -> DataFrame:
    """Range join: right_ts - left_ts in [-before, after] seconds (plus equality on ``on``).

    Both sides get a time bucket as wide as the window; the left row visits the buckets its window touches and
    an exact filter follows, so the join is a hash/sort join on (on, bucket) and a dense key is spread over its
    buckets instead of meeting in one task. A pair can only meet in the right row's single bucket.
    """
    width = int(max(before + after, 1.0) * 1_000_000)
    at = lambda c, shift: F.floor((F.unix_micros(c) + F.lit(int(shift * 1_000_000))) / F.lit(width))
    l = left.where(F.col(left_ts).isNotNull()).withColumn(
        "_bucket", F.explode(F.sequence(at(left_ts, -before), at(left_ts, after))))
    r = right.where(F.col(right_ts).isNotNull()).withColumn("_bucket", at(right_ts, 0.0))
    gap = F.unix_micros(right_ts) - F.unix_micros(left_ts)
    pairs = l.join(r, [*on, "_bucket"])
    return pairs.where((gap >= int(-before * 1_000_000)) & (gap <= int(after * 1_000_000))).withColumn(
        "delta_sec", gap / F.lit(1e6)).drop("_bucket")


def _anchored(records: DataFrame) -> DataFrame:
    return records.withColumn("anchor_ts", F.coalesce("printed_at", "created_at"))


def link_by_hint(records: DataFrame, sessions: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Hinted day -> session, only when exactly one session (of the machine, say) started that day."""
    hinted = records.where("session_id is null and hint_date is not null").select(
        "record_id", *on, F.col("hint_date").try_cast("date").alias("day"))
    days = sessions.groupBy(*on, F.to_date("start_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("session_id").alias("session_id")).where("_n = 1")
    return hinted.join(days, [*on, "day"]).select("record_id", "session_id", F.lit("hint").alias("method"))


def window_positions(left: DataFrame, right: DataFrame, left_id: str, left_ts: str, right_id: str, right_ts: str,
                     before: float, after: float, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Where the window [-before, +after] seconds of each left row falls among the ordered right rows.

    Returns (left rows with ``lo``..``hi``, right rows with ``pos``): the candidates of a left row are exactly the
    positions lo..hi (none when hi < lo). No pair is built: both window ends are placed among the right rows by one
    ordering and a running count, so dense windows cost the same as sparse ones.
    """
    micros = lambda x: F.expr(f"interval {int(x * 1_000_000)} microseconds")
    r = right.where(F.col(right_ts).isNotNull()).select(*on, F.col(right_id).alias("_id"), F.col(right_ts).alias("_ts"))
    numbered = Series(r, on, ["_ts", "_id"]).with_row_number("pos").frame.select(*on, "pos", F.col("_id").alias(right_id))
    l = left.where(F.col(left_ts).isNotNull()).select(*on, F.col(left_id).alias("_id"), F.col(left_ts).alias("_at"))
    # at equal stamps: window start, then right rows, then window end, because both ends are inclusive
    ends = F.inline(F.array(F.struct((F.col("_at") - micros(before)).alias("_ts"), F.lit(-1).alias("_kind")),
                            F.struct((F.col("_at") + micros(after)).alias("_ts"), F.lit(1).alias("_kind"))))
    points = l.select(*on, "_id", ends).unionByName(r.withColumn("_kind", F.lit(0)).select(*on, "_id", "_ts", "_kind"))
    points = points.withColumn("_one", (F.col("_kind") == 0).cast("long"))
    counted = Series(points, on, ["_ts", "_kind", "_id"]).with_running_sum("_upto", F.col("_one")).frame
    window = counted.where("_kind <> 0").groupBy(*on, "_id").agg(
        (F.min(F.when(F.col("_kind") == -1, F.col("_upto"))) + 1).alias("lo"),
        F.max(F.when(F.col("_kind") == 1, F.col("_upto"))).alias("hi"))
    return window.withColumnRenamed("_id", left_id), numbered


def lone_neighbour(left: DataFrame, right: DataFrame, left_id: str, left_ts: str, right_id: str, right_ts: str,
                   seconds: float, on: Sequence[str]) -> DataFrame:
    """Left rows with exactly one right row within +-``seconds``: (on, left_id, right_id)."""
    window, numbered = window_positions(left, right, left_id, left_ts, right_id, right_ts, seconds, seconds, on)
    single = window.where("hi = lo").select(*on, left_id, F.col("lo").alias("pos"))
    return single.join(numbered, [*on, "pos"]).drop("pos")


def link_by_time(records: DataFrame, sessions: DataFrame, hours: float = 24.0, on: Sequence[str] = ()) -> DataFrame:
    """Pairs within the window that are the only candidate for the record and for the session."""
    r = _anchored(records.where("session_id is null")).select("record_id", "anchor_ts", *on)
    s = sessions.where("start_ts is not null").select("session_id", "start_ts", *on)
    keys = list(on)
    if not keys:
        r, s, keys = r.withColumn("_all", F.lit(0)), s.withColumn("_all", F.lit(0)), ["_all"]
    args = hours * 3600, keys
    forth = lone_neighbour(r, s, "record_id", "anchor_ts", "session_id", "start_ts", *args)
    back = lone_neighbour(s, r, "session_id", "start_ts", "record_id", "anchor_ts", *args)
    both = forth.join(back, [*keys, "record_id", "session_id"])
    both = both.join(r, [*keys, "record_id"]).join(s, [*keys, "session_id"])
    return both.select("record_id", "session_id", *on, F.lit("time").alias("method"),
                       seconds_between(F.col("anchor_ts"), F.col("start_ts")).alias("delta_sec"))


def auto_link(records: DataFrame, sessions: DataFrame, hours: float = 24.0, on: Sequence[str] = ()) -> DataFrame:
    """Hints first, then the time window over what is left on both sides."""
    free = unclaimed(sessions, records)
    hints = link_by_hint(records, free, on)
    rest_r = records.join(hints.select("record_id"), "record_id", "left_anti")
    rest_s = free.join(hints.select("session_id"), "session_id", "left_anti")
    return hints.unionByName(link_by_time(rest_r, rest_s, hours, on).drop(*on), allowMissingColumns=True)


def link_candidates(records: DataFrame, sessions: DataFrame, hours: float = 24.0, on: Sequence[str] = ()) -> DataFrame:
    """Every unclaimed session near a record, with distance and duration."""
    window = hours * 3600
    free = sessions.select("session_id", "start_ts", "end_ts", *on)
    pairs = time_neighbours(_anchored(records).select("record_id", "anchor_ts", *on), free, "anchor_ts", "start_ts",
                            window, window, on)
    return pairs.select("record_id", "session_id", *on, "start_ts", "end_ts",
                        (seconds_between(F.col("start_ts"), F.col("end_ts")) / 60).alias("duration_min"),
                        (F.abs("delta_sec") / 3600).alias("hours_from_record_date"))


def _take_places(batches: Iterator[pa.RecordBatch], same: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (``same``, lo): each place goes to the earliest record that may have it and has none yet.

    Holds the records that wait at one place.
    """
    current, waiting, place = None, [], 0
    fields = None

    def served(upto: int | None) -> Iterator[tuple]:
        nonlocal place
        while waiting and (upto is None or place < upto):
            _, hi, row = heapq.heappop(waiting)
            if hi >= place:
                yield row, place
                place += 1

    def packed(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([row[i] for row, _ in found], f.type) for i, f in enumerate(fields)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([at for _, at in found], pa.int64())], names=[*[f.name for f in fields], "pos"])

    for batch in batches:
        fields, out = list(batch.schema), []
        names = [f.name for f in fields]
        key_at, lo_at, hi_at = [names.index(c) for c in same], names.index("lo"), names.index("hi")
        turn_at, id_at = names.index("record_no"), names.index("record_id")
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = [row[i] for i in key_at]
            if key != current:
                out += served(None)
                current, place = key, row[lo_at]
            out += served(row[lo_at])
            place = max(place, row[lo_at])
            heapq.heappush(waiting, ((row[turn_at], row[id_at]), row[hi_at], row))
        if out:
            yield packed(out)
    last = list(served(None))
    if last:
        yield packed(last)


def link_forward(records: DataFrame, sessions: DataFrame, days: int = 45, on: Sequence[str] = ()) -> DataFrame:
    """In record order each record takes the nearest unused session 0..``days`` days later.

    records(record_id, record_no, record_day), sessions(session_id, session_day). The candidates of a record are
    a run of session positions. Taking turns in one common order gives every position to the earliest record that may
    have it and has no earlier position, so one pass over the positions settles all. Positions in use form runs that
    no record crosses: a run goes on as long as more records have asked than positions have passed, which is one running
    maximum over the counts per position. Runs are independent and spread over tasks; inside a run the records that
    wait stand in a heap. A plan without turns: nothing is written or counted while it is built.
    """
    keys = list(on) or ["_all"]
    r = records.select("record_id", "record_no", F.to_timestamp("record_day").alias("_rd"), *on)
    s = sessions.select("session_id", F.to_timestamp("session_day").alias("_sd"), *on)
    if not on:
        r, s = r.withColumn("_all", F.lit(0)), s.withColumn("_all", F.lit(0))
    window, numbered = window_positions(r, s, "record_id", "_rd", "session_id", "_sd", 0.0, days * 86400.0, keys)
    asks = window.where("hi >= lo").join(r, [*keys, "record_id"]).select(*keys, "record_id", "record_no", "_rd", "lo", "hi")
    crowds = asks.groupBy(*keys, "lo").agg(F.count(F.lit(1)).alias("_c"))
    runs = Series(crowds, keys, ["lo"]).with_running_sum("_asked", F.col("_c"))
    # a run ends where a place is reached that lies behind all that asked before; until then this maximum stays
    runs = runs.with_running_max("_run", F.col("lo") - (F.col("_asked") - F.col("_c")))
    placed = asks.join(runs.frame.select(*keys, "lo", "_run"), [*keys, "lo"])
    same = [*keys, "_run"]
    placed = placed.repartition(*same).sortWithinPartitions(*same, "lo", "record_no", "record_id")
    found = placed.mapInArrow(lambda batches: _take_places(batches, same), T.StructType([*placed.schema, T.StructField("pos", T.LongType())]))
    linked = found.join(numbered, [*keys, "pos"]).join(s, [*keys, "session_id"])
    return linked.select("record_id", "session_id", seconds_between(F.col("_rd"), F.col("_sd")).alias("delta_sec"))


def accumulated_since_service(sessions: DataFrame, maintenance: DataFrame, consumables: DataFrame,
                              classes: Sequence[str]) -> DataFrame:
    """Hours printed per consumable since its last service, share used and state.

    Services are placed among the sessions by time; the running minutes up to a service, taken from all minutes, leave
    what was printed since. No session meets a consumable.
    """
    last = maintenance.groupBy("component").agg(F.max("timestamp").alias("last_service"))
    dim = consumables.join(last, "component", "left")
    printed = sessions.where(F.col("classification").isin(*classes)).select("start_ts", F.coalesce(
        "duration_min", F.lit(0.0)).alias("_min"))
    # a service sorts in front of a session of the same time; a session without a start counts for every consumable
    points = printed.where("start_ts is not null").select(F.lit(0).alias("_all"), "start_ts", F.lit(1).alias("_kind"), F.lit("").alias("component"), "_min")
    points = points.unionByName(last.where("last_service is not null").select(
        F.lit(0).alias("_all"), F.col("last_service").alias("start_ts"), F.lit(0).alias("_kind"), "component", F.lit(0.0).alias("_min")))
    before = Series(points, ["_all"], ["start_ts", "_kind", "component"]).with_running_sum("_before", F.col("_min")).frame.where("_kind = 0")
    total = printed.agg(F.sum("_min").alias("_total")).withColumn("_all", F.lit(0))
    out = dim.withColumn("_all", F.lit(0)).join(total, "_all").join(before.select("component", "_before"), "component", "left")
    used = (F.coalesce("_total", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0))) / 60
    share = F.least(F.lit(100.0), used / F.col("max_hours") * 100)
    state = first_match([(share >= 100, "critical"), (share >= F.col("warn_pct"), "warning")], "ok")
    return out.select("component", "label", "last_service", used.alias("used_hours"), "max_hours", share.alias("pct"),
                      F.greatest(F.lit(0.0), F.col("max_hours") - used).alias("remaining_hours"), state.alias("grade"))


def overlay_params(params: DataFrame, presets: DataFrame, columns: Sequence[str] = tuple(PRESET_COLUMNS), order: str = "preset_id") -> DataFrame:
    """Default preset of each material over the global row: a preset value wins unless it is null.

    params has one row per material asked for (material + global values), presets(preset_id, material, is_default, ...).
    Of several default presets of a material the one with the smallest ``order`` counts, so no row is multiplied.
    """
    values = F.struct(*[F.col(c).alias(f"_p_{c}") for c in columns])
    default = presets.where("is_default").groupBy(F.lower("material").alias("_m")).agg(F.min_by(values, order).alias("_p"))
    default = default.select("_m", "_p.*")
    df = params.join(default, F.lower("material") == F.col("_m"), "left")
    merged = [F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in params.columns]
    return df.select(*merged, F.col("_m").isNotNull().alias("preset_used"))


def params_ready(columns: Sequence[str] = tuple(REQUIRED_PARAMS)) -> Column:
    """All parameters the estimate cannot do without are set."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def history_rows(cycles: DataFrame) -> DataFrame:
    """Stored history arrays (array<struct<event, kg>>) as rows: batch_id, cycle_id, event, kg."""
    return cycles.select("batch_id", "cycle_id", F.explode("history").alias("_h")).select(
        "batch_id", "cycle_id", "_h.event", F.col("_h.kg").cast("double").alias("kg"))


def batch_report(batches: DataFrame, cycles: DataFrame, history: DataFrame) -> DataFrame:
    """Powder per batch: consumed, left, reuse and quality grade.

    batches(batch_id, material, batch_code, initial_kg, created_at), cycles(cycle_id, batch_id, reuse_count,
    started_at), history(batch_id, event, kg) in long form, summed map-side.
    """
    used = history.where("event = 'consumed'").groupBy("batch_id").agg(F.sum("kg").alias("_kg"))
    per = cycles.groupBy("batch_id").agg(
        F.max("reuse_count").alias("_reuse"),
        F.max_by(F.struct("cycle_id", "reuse_count"), F.struct("started_at", "cycle_id")).alias("_last"))
    per = per.join(used, "batch_id", "full")
    df = batches.join(per, "batch_id", "left")
    used, initial = F.coalesce("_kg", F.lit(0.0)), F.coalesce("initial_kg", F.lit(0.0))
    reuse = F.coalesce("_reuse", F.lit(0))
    quality = F.greatest(F.lit(0), 100 - 8 * reuse).cast("double")
    return df.select(
        "batch_id", "material", "batch_code", initial.alias("initial_kg"), used.alias("consumed_kg"),
        (initial - used).alias("remaining_kg"), F.greatest(F.lit(0.0), initial - used).alias("remaining_kg_floor"),
        F.when(initial > 0, F.greatest(F.lit(0.0), (initial - used) / initial * 100)).otherwise(0.0).alias("remaining_pct"),
        F.coalesce("_last.reuse_count", F.lit(0)).cast("long").alias("reuse_count"), F.col("_last.cycle_id").alias("active_cycle"),
        quality.alias("quality_pct"),
        first_match([(quality >= 70, "ok"), (quality >= 40, "warning")], "critical").alias("quality_grade"))


def last_price(records: DataFrame, default: Column | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Newest known powder price, else ``default``."""
    known = F.when(F.col("powder_cost").isNotNull(), F.struct("created_at", "record_id"))
    price = F.max_by("powder_cost", known)
    price = F.coalesce(price, default) if default is not None else price
    grouped = records.groupBy(*on) if on else records
    return grouped.agg(price.alias("powder_cost"))


def time_adjacency(items: DataFrame, keys: Sequence[str], tie: Sequence[str], near_seconds: float = 3600.0) -> DataFrame:
    """Edges between neighbours in time (null stamps sort first and make no edge)."""
    s = Series(items, keys, ["ts", *tie]).with_next(target="id", _ts="ts", target_kind="kind", target_type="event_type")
    delta = seconds_between(F.col("ts"), F.col("_ts"))
    out = s.frame.where("ts is not null and _ts is not null").withColumn("delta_sec", delta)
    near = F.when(F.col("delta_sec") <= near_seconds, "temporally_near").otherwise("precedes")
    return out.select(*keys, F.col("id").alias("source"), F.col("kind").alias("source_kind"),
                      F.col("event_type").alias("source_type"), "target", "target_kind", "target_type",
                      near.alias("relationship"), "delta_sec")


def asof_latest(points: DataFrame, facts: DataFrame, keys: Sequence[str], point_ts: str, fact_ts: str,
                values: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """As-of join: newest non-null ``values`` of ``facts`` at or before each point.

    One merged ordering and a carried last value instead of a theta join; a fact with the stamp of the point
    counts. Points keep all their columns; each value gets a ``<value>_at`` stamp.
    """
    carried = {v: F.struct(F.col(fact_ts).alias("at"), F.col(v).alias("v")) for v in values}
    f = facts.select(*keys, F.col(fact_ts).alias("_ts"), F.lit(0).alias("_kind"),
                     F.struct(*[F.col(t).cast("string") for t in tie]).alias("_tie"),
                     *[F.when(F.col(v).isNotNull(), c).alias(f"_v_{v}") for v, c in carried.items()])
    p = points.select("*", F.col(point_ts).alias("_ts"), F.lit(1).alias("_kind"))
    both = p.unionByName(f, allowMissingColumns=True)
    s = Series(both, keys, ["_ts", "_kind", "_tie"]).with_last_before(**{f"_l_{v}": f"_v_{v}" for v in values})
    out = s.frame.where("_kind = 1")
    return out.select(*points.columns, *[x for v in values for x in (
        F.col(f"_l_{v}.v").alias(v), F.col(f"_l_{v}.at").alias(f"{v}_at"))])
