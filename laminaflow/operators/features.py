"""Per-layer, per-signal and per-session features, phases, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import finite, first_match, seconds_between
from laminaflow.model import KG_PER_LAYER
from laminaflow.operators.ordered import Series, group_quantiles, null_safe_join
from laminaflow.operators.robust import robust_z, stride_slope
from laminaflow.operators.slopes import theil_sen


def signal_stats(readings: DataFrame, dimension: DataFrame, keys: Sequence[str] = ("session_id", "signal"),
                 order: Sequence[str] = ("idx",), min_rows: int = 10, slope: bool = True) -> DataFrame:
    """Full-resolution statistics per key over finite values: moments, exact quantiles, alarms, slope.

    Moments and alarm counts combine map-side, quantiles and the median of all pairwise slopes go through the hot-key kernels.
    """
    keys = list(keys)
    limits = F.broadcast(dimension.select("signal", "group", "alarm_low", "alarm_high"))
    clean = readings.where(finite(F.col("value")))
    tagged = clean.join(limits, "signal", "left")
    facts = {
        "group": F.first("group", ignorenulls=True), "n": F.count(F.lit(1)), "mean": F.avg("value"), "std": F.stddev_pop("value"),
        "min": F.min("value"), "max": F.max("value"),
        "alarm_count": F.count_if(F.col("value") > F.col("alarm_high")) + F.count_if(F.col("value") < F.col("alarm_low"))}
    out = group_quantiles(tagged, keys, "value", {"p05": 0.05, "p95": 0.95, "p99": 0.99}, extra=facts).where(F.col("n") >= min_rows)
    if slope:
        out = out.join(theil_sen(clean, keys, order, "value", "trend_slope").drop("n"), keys)
    return out


def compact_signal_stats(readings: DataFrame, keys: Sequence[str] = ("session_id", "signal"),
                         order: Sequence[str] = ("idx",), min_rows: int = 5) -> DataFrame:
    """Statistics of short stored series: nearest-rank quantiles and the stride slope."""
    keys = list(keys)
    clean = readings.where(finite(F.col("value")))
    facts = {"n": F.count(F.lit(1)), "mean": F.avg("value"), "std": F.stddev_pop("value"), "min": F.min("value"), "max": F.max("value")}
    out = group_quantiles(clean, keys, "value", {"p05_nearest": 0.05, "p95_nearest": 0.95}, nearest=True, extra=facts)
    return out.where(F.col("n") >= min_rows).join(stride_slope(clean, keys, order, "value"), keys)


def wide_signal_stats(stats: DataFrame, signals: Sequence[str],
                      metrics: Sequence[str] = ("mean", "std", "p95", "p99", "alarm_count", "trend_slope")) -> DataFrame:
    """One row per session with ``<signal>__<metric>`` columns; the signal list is fixed by the caller."""
    return stats.groupBy("session_id", "start_ts").pivot("signal", list(signals)).agg(
        *[F.first(m).alias(f"_{m}") for m in metrics])


def layer_features(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Per layer: events, duration, change against the last layer that had a duration, event types."""
    usable = events.where("layer is not null and ts is not null")
    span = seconds_between(F.min("ts"), F.max("ts"))
    layers = usable.groupBy(key, "layer").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.when(F.count(F.lit(1)) >= 2, span).alias("layer_duration_sec"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"))
    out = Series(layers, [key], ["layer"]).with_last_before(_before="layer_duration_sec").frame
    return out.select(key, "layer", "event_count", "layer_duration_sec",
                      (F.col("layer_duration_sec") - F.col("_before")).alias("delta_from_previous_layer_sec"),
                      "event_types")


def layer_outliers(features: DataFrame, key: str = "session_id", threshold: float = 3.5) -> DataFrame:
    """Layers whose duration is a robust outlier within the session."""
    scored = robust_z(features.where("layer_duration_sec is not null"), [key], "layer_duration_sec")
    return scored.where(F.abs("robust_z") >= threshold).select(
        key, "layer", "layer_duration_sec", "robust_z", F.lit("layer_duration_outlier").alias("anomaly_type"),
        F.lit("warning").alias("severity"),
        F.least(F.abs("robust_z") / (threshold * 2), F.lit(0.95)).alias("confidence"))


def state_churn(transitions: DataFrame, key: str = "session_id", threshold: int = 20) -> DataFrame:
    return transitions.groupBy(key).agg(F.count(F.lit(1)).alias("transition_count")).where(
        F.col("transition_count") >= threshold).select(
        key, "transition_count", F.lit("state_churn").alias("anomaly_type"),
        F.lit("warning").alias("severity"), F.lit(0.65).alias("confidence"))


def session_features(events: DataFrame, transitions: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Counts, completion, service density, subsystem counts and span per session."""
    of = lambda *types: F.count_if(F.col("event_type").isin(*types))
    e = events.groupBy("session_id").agg(
        of("finish").alias("_finished"), of("pause").alias("pause_count"),
        of("restart_attempt", "resume").alias("restart_attempt_count"),
        F.min("ts").alias("_e0"), F.max("ts").alias("_e1"))
    parts = transitions.groupBy("session_id", F.coalesce("subsystem", F.lit("unknown")).alias("subsystem")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_start").alias("t0"), F.max("ts_start").alias("t1"))
    t = parts.groupBy("session_id").agg(
        F.sum(F.when(F.col("subsystem").isin("door", "glove"), F.col("n")).otherwise(0)).alias("service_state_density"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("subsystem", "n")))).alias("subsystem_instability"),
        F.min("t0").alias("_t0"), F.max("t1").alias("_t1"))
    df = e.join(t, "session_id", "full")
    out = df.select(
        "session_id", F.when(F.col("_finished") > 0, "finished").otherwise("unknown").alias("completion_status"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in
          ("pause_count", "restart_attempt_count", "service_state_density")],
        "subsystem_instability",
        seconds_between(F.least("_e0", "_t0"), F.greatest("_e1", "_t1")).alias("duration_sec"))
    if context is None:
        return out
    return out.join(context.select("session_id", "material", "powder_batch", "gas_cylinder_id"), "session_id", "left")


def print_span(events: DataFrame, transitions: DataFrame, daemon_family: str = "monitor100_log") -> DataFrame:
    """First and last stamp per session; the always-running daemon log does not count."""
    own = lambda df, ts: df.where((F.col("family") != daemon_family) & F.col(ts).isNotNull()).select(
        "session_id", F.col(ts).alias("ts"))
    stamps = own(events, "ts").unionByName(own(transitions, "ts_start"))
    return stamps.groupBy("session_id").agg(F.min("ts").alias("span_start"), F.max("ts").alias("span_end"))


def session_overview(sessions: DataFrame, files: DataFrame, events: DataFrame, transitions: DataFrame,
                     context: DataFrame | None = None) -> DataFrame:
    """Display facts per session: one aggregate over each long table, joined on the session.

    sessions(session_id, start_ts, end_ts); files(session_id, line_count); events and transitions carry family.
    """
    burn = F.contains(F.lower("event_type"), F.lit("burn")) | (F.trim(F.lower("phase")) == "burn")
    e = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(burn).alias("burn_events"),
        F.count_distinct("layer").alias("layers"))
    f = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("line_count").alias("total_lines"))
    df = (sessions.select("session_id", "start_ts", "end_ts")
          .join(session_features(events, transitions, context).drop("duration_sec"), "session_id", "left")
          .join(e, "session_id", "left").join(f, "session_id", "left")
          .join(print_span(events, transitions), "session_id", "left"))
    span = F.when(F.col("span_end") > F.col("span_start"), seconds_between(F.col("span_start"), F.col("span_end")))
    anchors = F.when(F.col("end_ts") > F.col("start_ts"), seconds_between(F.col("start_ts"), F.col("end_ts")))
    df = df.withColumn("duration_sec", F.coalesce(span, anchors, F.lit(0.0)))
    start, end = F.coalesce("span_start", "start_ts"), F.coalesce("span_end", "end_ts")
    clock = lambda c: F.coalesce(F.date_format(c, "HH:mm"), F.lit("-"))
    counts = ["total_events", "burn_events", "layers", "file_count", "total_lines", "pause_count",
              "restart_attempt_count", "service_state_density"]
    material = F.col("material") if "material" in df.columns else F.lit(None).cast("string")
    return df.select(
        "session_id", start.alias("start_ts"), end.alias("end_ts"), clock(start).alias("first_time"),
        clock(end).alias("last_time"), "duration_sec", (F.col("duration_sec") / 60).alias("duration_min"),
        F.coalesce("completion_status", F.lit("unknown")).alias("completion_status"), "subsystem_instability",
        F.coalesce(material, F.lit("unknown")).alias("material"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def layer_burn_times(timing: DataFrame, burn_rows: DataFrame | None = None) -> DataFrame:
    """Burn seconds per layer from the best source each session has.

    1. the machine's own summary (first positive one per layer); 2. end minus start counters; 3. the clock span
    of the layer in a burn table. A later source is used only by sessions without any row from the earlier ones.
    ``timing`` is the timing-log event table with session_id, ``burn_rows`` (session_id, layer, clock_sec).
    """
    key = ["session_id", "layer"]
    place = F.struct("source_file_id", "source_line", "entry_no")
    own = timing.where("event_type = 'layer_timing_summary' and burn_ms > 0").groupBy(*key).agg(
        (F.min_by("burn_ms", place) / 1000).alias("duration_sec"))
    counters = timing.where("event_type in ('burn_start', 'burn_end') and abs_ms is not null").groupBy(*key).agg(
        (F.max_by("abs_ms", F.when(F.col("event_type") == "burn_end", place))
         - F.min_by("abs_ms", F.when(F.col("event_type") == "burn_start", place))).alias("_ms"))
    counters = counters.where("_ms > 0").select(*key, (F.col("_ms") / 1000).alias("duration_sec"))
    sources = [own, counters]
    if burn_rows is not None:
        spans = burn_rows.where("layer is not null and clock_sec is not null").groupBy(*key).agg(
            (F.max("clock_sec") - F.min("clock_sec")).alias("duration_sec"))
        sources.append(spans)
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    best = every.groupBy("session_id").agg(F.min("_source").alias("_source"))
    return every.join(best, ["session_id", "_source"]).select(*key, "duration_sec", F.col("_source").alias("source_rank"))


# Event type / subsystem -> phase when the log gives none.
SUBSYSTEM_PHASES = {
    "heating": "heat_up", "chamber": "chamber_prep", "glove": "chamber_prep", "door": "chamber_prep",
    "parameter_check": "parameter_check", "powder": "powder_prep", "laser_interlock": "restart_attempts",
}


def phase_of(event_type: Column) -> Column:
    return first_match([
        (F.contains(event_type, F.lit("burn")), "burn"), (F.contains(event_type, F.lit("pour")), "pour"),
        (event_type == "pause", "pause"), (event_type.isin("resume", "restart_attempt"), "restart_attempts")])


def phase_segments(events: DataFrame, transitions: DataFrame | None, tie: Sequence[str],
                   key: str = "session_id") -> DataFrame:
    """Runs of equal phase in time order; sessions without any take their phases from state transitions.

    A run ends where the next one starts; the last run ends at its own last event when it has more than one.
    """
    df = events.where("ts is not null").withColumn("_ph", F.coalesce("phase", phase_of(F.col("event_type"))))
    s = Series(df.where("_ph is not null"), [key], ["ts", *tie]).with_prev(_before="_ph")
    fresh = F.col("_before").isNull() | (F.col("_before") != F.col("_ph"))
    s = s.with_column("_new", fresh.cast("long")).with_running_sum("segment_no", F.col("_new"))
    place = F.struct("ts", *tie)
    runs = s.frame.groupBy(key, "segment_no").agg(
        F.first("_ph").alias("phase"), F.min("ts").alias("ts_start"), F.max("ts").alias("_last"),
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("layer", place).alias("layer_start"),
        F.max_by("layer", F.when(F.col("layer").isNotNull(), place)).alias("layer_end"),
        F.min_by("confidence", place).alias("confidence"))
    # runs are numbered without gaps
    starts = runs.select(key, (F.col("segment_no") - 1).alias("segment_no"), F.col("ts_start").alias("_next"))
    runs = null_safe_join(runs, starts, [key, "segment_no"])
    end = F.coalesce("_next", F.when(F.col("event_count") > 1, F.col("_last")))
    segments = runs.select(key, "segment_no", "phase", "ts_start", end.alias("ts_end"), "layer_start", "layer_end",
                           "confidence", "event_count")
    if transitions is None:
        return segments
    named = first_match([(F.col("subsystem") == k, v) for k, v in SUBSYSTEM_PHASES.items()])
    spare = transitions.join(segments.select(key).distinct(), key, "left_anti").select(
        key, named.alias("phase"), "ts_start", "ts_end", F.lit(0.45).alias("confidence")).where("phase is not null")
    return segments.unionByName(spare, allowMissingColumns=True)


def dedup_key(bucket_seconds: float = 2.0, raw: str = "line_sha") -> list[Column]:
    """Columns under which two events are the same: time bucket, type, layer, subsystem, or the whole line (its digest)."""
    has_ts = F.col("ts").isNotNull()
    bucket = F.floor(F.unix_micros("ts") / F.lit(int(bucket_seconds * 1_000_000)))
    return [F.when(has_ts, bucket).alias("bucket"), "event_type", "layer",
            F.when(has_ts, F.col("subsystem")).alias("_subsystem"),
            F.when(~has_ts, F.col(raw)).alias("_raw")]


def deduplicate(events: DataFrame, order: Sequence[str], bucket_seconds: float = 2.0,
                scope: Sequence[str] = ("session_id",)) -> DataFrame:
    """First event of each group of equals with the best confidence and the number of copies.

    The copies themselves are never gathered; ``dedup_provenance`` lists them as rows.
    """
    place = F.struct(*order)
    packed = F.struct(*[c for c in events.columns if c not in scope])
    out = events.groupBy(*scope, *dedup_key(bucket_seconds)).agg(
        F.min_by(packed, place).alias("_e"), F.max("confidence").alias("_best"),
        F.count(F.lit(1)).alias("copies"))
    return out.select(*scope, *[F.col("_best" if c == "confidence" else f"_e.{c}").alias(c)
                                for c in events.columns if c not in scope], "copies")


def dedup_provenance(events: DataFrame, order: Sequence[str], bucket_seconds: float = 2.0,
                     scope: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per original event of a group with copies, tagged with the surviving event's position."""
    keyed = events.select("*", *[c for c in dedup_key(bucket_seconds) if not isinstance(c, str)])
    key = [*scope, "bucket", "event_type", "layer", "_subsystem", "_raw"]
    heads = keyed.groupBy(*key).agg(F.min(F.struct(*order)).alias("kept"), F.count(F.lit(1)).alias("copies"))
    return null_safe_join(keyed, heads.where("copies > 1"), key, "inner").select(*scope, *order, "kept", "copies")


def dedup_diagnostics(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.where("copies > 1").select(
        "session_id", F.lit("deduplicated_semantic_equivalent_events").alias("code"), "event_type", "copies")


def consumption_by_layers(layers: Column) -> Column:
    return layers * F.lit(KG_PER_LAYER)
