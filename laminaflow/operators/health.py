"""Process health: anomalies, burn drift, atmosphere readiness, tail alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import finite, first_match, grade
from laminaflow.model import ANOMALY_GROUPS, READINESS_WEIGHTS
from laminaflow.operators.ordered import Series
from laminaflow.operators.robust import robust_spike, z_score


def process_anomalies(readings: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Spikes of the watched groups. readings(session_id, group, signal, idx, value)."""
    watched = readings.where(F.col("group").isin(*ANOMALY_GROUPS))
    spikes = robust_spike(watched, ["session_id", "group", "signal"], "idx", "value")
    of = lambda i: first_match([(F.col("group") == g, v[i]) for g, v in ANOMALY_GROUPS.items()])
    return spikes.where(F.abs("z_score") >= threshold).select(
        "session_id", "signal", of(0).alias("semantic"), F.lit("spike").alias("kind"), of(1).alias("severity"),
        F.col("peak").alias("value"), "z_score", "max_value")


def burn_drift(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per session: trend of the burn time over layers; second table: all its outlier layers with their position."""
    points = layers.where("duration_sec > 0")
    fit = points.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_layers"), F.avg("duration_sec").alias("_mean"),
        F.regr_slope(F.col("duration_sec"), F.col("layer").cast("double")).alias("_slope"))
    fit = layers.select("session_id").distinct().join(fit, "session_id", "left")
    n = F.coalesce("n_layers", F.lit(0).cast("long"))
    enough = n >= 3
    slope = F.coalesce("_slope", F.lit(0.0))
    rel = slope / F.col("_mean")
    trend = first_match([(~enough, "insufficient_data"), (rel > 0.01, "rising"), (rel < -0.01, "falling")], "stable")
    drift = fit.select("session_id", n.alias("n_layers"), F.when(enough, F.col("_mean")).alias("mean_sec"),
                       F.when(enough, slope).alias("slope_sec_per_layer"), trend.alias("trend"))
    judged = points.join(drift.where("trend <> 'insufficient_data'").select("session_id"), "session_id")
    far = z_score(judged, ["session_id"], "duration_sec", "z_score").where("abs(z_score) >= 3")
    ranked = Series(far, ["session_id"], ["layer"]).with_row_number("position").frame
    return drift, ranked.select("session_id", "position", "layer", "duration_sec", "z_score")


def atmosphere_readiness(readings: DataFrame) -> DataFrame:
    """0..100 stability score from the coefficients of variation of the weighted groups.

    Computed from map-side combined moments: signal -> group -> session.
    """
    usable = readings.where(F.col("group").isin(*READINESS_WEIGHTS) & finite(F.col("value")))
    signal = usable.groupBy("session_id", "group", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where("n >= 5")
    cv = F.when(F.col("m") == 0, 0.0).otherwise(F.col("s") / F.abs("m"))
    factor = F.greatest(F.lit(0.0), 1 - F.avg(cv) / 0.5)
    groups = signal.groupBy("session_id", "group").agg(factor.alias("factor"))
    weight = first_match([(F.col("group") == g, w) for g, w in READINESS_WEIGHTS.items()])
    of = lambda g: F.max(F.when(F.col("group") == g, F.col("factor"))).alias(f"{g}_factor")
    scored = groups.groupBy("session_id").agg(
        (F.sum(F.col("factor") * weight) / F.sum(weight) * 100).alias("score"), *[of(g) for g in READINESS_WEIGHTS])
    out = readings.select("session_id").distinct().join(scored, "session_id", "left")
    return out.select("*", F.coalesce(grade(F.round("score", 9), 75, 50), F.lit("unknown")).alias("grade"))


def process_health(readings: DataFrame, layers: DataFrame) -> DataFrame:
    """One row per session: anomaly count, burn drift, readiness."""
    anomalies = process_anomalies(readings).groupBy("session_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    drift, _ = burn_drift(layers)
    ready = atmosphere_readiness(readings).select("session_id", F.col("score").alias("readiness"),
                                                  F.col("grade").alias("readiness_grade"))
    out = ready.join(drift, "session_id", "full").join(anomalies, "session_id", "left")
    return out.withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0).cast("long"))).withColumn(
        "trend", F.coalesce("trend", F.lit("insufficient_data")))


def tail_alarm(readings: DataFrame, limits: DataFrame, tail: int = 10) -> DataFrame:
    """Per (session, group): any of the last ``tail`` points of a member signal beyond the group's limits.

    limits(group, alarm_high, alarm_low). The tail is found from the end by position, so only ``tail`` rows per
    signal reach the comparison.
    """
    s = Series(readings, ["session_id", "group", "signal"], ["idx"]).with_row_number("_rn").with_count("_n")
    last = s.frame.where((F.col("_n") - F.col("_rn") < tail) & finite(F.col("value")))
    return last.join(F.broadcast(limits), "group").groupBy("session_id", "group").agg(
        F.coalesce(F.bool_or(F.coalesce(F.col("value") > F.col("alarm_high"), F.lit(False))
                             | F.coalesce(F.col("value") < F.col("alarm_low"), F.lit(False))),
                   F.lit(False)).alias("in_alarm"))
