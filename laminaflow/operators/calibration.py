"""Predicted against actual duration, calibration factors, print-time and cost arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match, seconds_between
from laminaflow.operators.ordered import Series, group_medians

MIN_PAIRS = 3
WINDOW = 20
FACTOR_RANGE = (0.5, 2.0)
# Machine defaults used when a parameter is not set.
DEFAULT_JUMP_SPEED, DEFAULT_JUMP_DELAY_MS, DEFAULT_RECOAT_MS = 5000.0, 0.0, 9500.0


def accuracy_pairs(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records with a prediction and a session of positive duration."""
    hours = seconds_between(F.col("start_ts"), F.col("end_ts")) / 3600
    actual = sessions.select("session_id", "start_ts", hours.alias("actual_hours")).where("actual_hours > 0")
    predicted = records.where("raw_print_hours > 0").select(
        "record_id", "session_id", F.coalesce("material", F.lit("—")).alias("material"),
        F.col("raw_print_hours").alias("predicted_hours"))
    out = predicted.join(actual, "session_id")
    return out.withColumn("ratio", F.col("actual_hours") / F.col("predicted_hours")).withColumn(
        "error_pct", (F.col("predicted_hours") - F.col("actual_hours")) / F.col("actual_hours") * 100)


def _recent_median(pairs: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    s = Series(pairs, keys, ["start_ts", "record_id"]).with_row_number("_rn").with_count("n_pairs")
    recent = s.frame.where(F.col("n_pairs") - F.col("_rn") < window)
    # the median runs over at most ``window`` rows per key
    return recent.groupBy(*keys).agg(F.first("n_pairs").alias("n_pairs"), F.median("ratio").alias("_m")).select(
        *keys, "n_pairs", F.when(F.col("n_pairs") >= MIN_PAIRS, F.col("_m")).alias("suggested_factor"))


def calibration_factors(pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Median actual/predicted of the latest pairs per material, null below three pairs."""
    return _recent_median(pairs, ["material"], window)


def overall_factor(pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    return _recent_median(pairs.withColumn("_all", F.lit(0)), ["_all"], window).drop("_all")


def recalibrate(factors: DataFrame, current: DataFrame, locked: bool = False) -> DataFrame:
    """Decision per material: applied, unchanged, out_of_range, too_few_pairs, locked; and the factor in force after it.

    current(material, factor).
    """
    low, high = FACTOR_RANGE
    new = F.round("suggested_factor", 3)
    df = factors.select("material", "n_pairs", new.alias("new_factor")).join(
        current.select("material", F.col("factor").alias("old_factor")), "material", "full")
    status = first_match([
        (F.lit(locked), "locked"),
        (F.col("new_factor").isNull(), "too_few_pairs"),
        (~F.col("new_factor").between(low, high), "out_of_range"),
        (F.col("new_factor") == F.col("old_factor"), "unchanged")], "applied")
    return df.withColumn("status", status).withColumn(
        "factor", F.when(F.col("status") == "applied", F.col("new_factor")).otherwise(F.col("old_factor")))


def correction_factor(by_material: Column, material: Column, overall: Column) -> Column:
    """Material's own factor, else the global one, else 1; anything not positive means 1."""
    factor = F.coalesce(F.try_element_at(by_material, material), overall)
    return F.when(factor > 0, factor).otherwise(1.0)


def print_time(slices: DataFrame) -> DataFrame:
    """Hours from per-layer vector lengths and machine parameters on the same row.

    Needs hatch_len_mm, contour_len_mm, jump_len_mm, n_jumps, layer_count, hatch_speed_mm_s, contour_speed_mm_s,
    jump_speed_mm_s, jump_delay_ms, recoat_time_ms, laser_count, correction_factor. Rows without a hatch speed
    or a laser come back with a reason instead of hours.
    """
    c = F.col
    set_or = lambda name, default: F.when(c(name) > 0, c(name)).otherwise(F.lit(default))
    contour = F.when(c("contour_speed_mm_s") > 0, c("contour_len_mm") / c("contour_speed_mm_s")).otherwise(0.0)
    layer = (c("hatch_len_mm") / c("hatch_speed_mm_s") + contour
             + c("jump_len_mm") / set_or("jump_speed_mm_s", DEFAULT_JUMP_SPEED)
             + c("n_jumps") * set_or("jump_delay_ms", DEFAULT_JUMP_DELAY_MS) / 1000)
    ok = (c("hatch_speed_mm_s") > 0) & (c("laser_count") >= 1)
    scan = F.when(ok, layer * c("layer_count") / c("laser_count") / 3600)
    recoat = c("layer_count") * set_or("recoat_time_ms", DEFAULT_RECOAT_MS) / 1000 / 3600
    factor = F.coalesce("correction_factor", F.lit(1.0))
    notes = F.filter(F.array(
        F.when(~F.coalesce(c("contour_speed_mm_s") > 0, F.lit(False)), F.lit("contour_speed_missing")),
        F.when(~F.coalesce(c("jump_speed_mm_s") > 0, F.lit(False)), F.lit("jump_speed_default")),
        F.when(~F.coalesce(c("recoat_time_ms") > 0, F.lit(False)), F.lit("recoat_time_default"))), lambda x: x.isNotNull())
    reason = first_match([(~F.coalesce(c("hatch_speed_mm_s") > 0, F.lit(False)), "hatch_speed_missing"),
                          (~F.coalesce(c("laser_count") >= 1, F.lit(False)), "laser_count_missing")])
    return slices.select(
        "*", (scan * factor).alias("scan_hours"), F.when(ok, recoat * factor).alias("recoat_hours"),
        ((scan + recoat) * factor).alias("print_hours"), (scan + recoat).alias("raw_print_hours"),
        ((scan + recoat) * factor / 24).alias("total_days"), notes.alias("time_warnings"), reason.alias("unavailable_reason"))


def cost(jobs: DataFrame) -> DataFrame:
    """Cost lines from volume, hours and rates on the same row; a missing rate drops its line with a warning.

    Needs volume_mm3, density_g_cm3, powder_cost, gas_cost_per_atm, gas_atm_per_print, filter_cost,
    filter_lifetime_hours, platform_cost, print_hours.
    """
    c = F.col
    known = lambda *names: F.forall(F.array(*[c(n).cast("double") for n in names]), lambda v: F.coalesce(v != 0, F.lit(False)))
    kg = F.when(known("density_g_cm3"), c("volume_mm3") / 1000 * c("density_g_cm3") / 1000)
    lines = {
        "powder_line": F.when(known("density_g_cm3", "powder_cost"), kg * c("powder_cost")),
        "gas_line": F.when(known("gas_cost_per_atm", "gas_atm_per_print"), c("gas_cost_per_atm") * c("gas_atm_per_print")),
        "filter_line": F.when(known("filter_cost", "filter_lifetime_hours"),
                              c("print_hours") / c("filter_lifetime_hours") * c("filter_cost")),
        "platform_line": F.when(known("platform_cost"), c("platform_cost")),
    }
    out = jobs.select("*", kg.alias("powder_kg"), *[v.alias(k) for k, v in lines.items()])
    total = sum((F.coalesce(k, F.lit(0.0)) for k in lines), F.lit(0.0))
    gaps = F.filter(F.array(
        F.when(~known("density_g_cm3"), F.lit("density_missing")).when(c("powder_line").isNull(), F.lit("powder_price_missing")),
        F.when(c("gas_line").isNull(), F.lit("gas_rate_missing")),
        F.when(c("filter_line").isNull(), F.lit("filter_rate_missing")),
        F.when(c("platform_line").isNull(), F.lit("platform_rate_missing"))), lambda x: x.isNotNull())
    return out.select("*", total.alias("total_cost"), gaps.alias("cost_warnings"))


def platform_rollup(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All parts of a platform as one build: scan adds up, recoating follows the tallest part.

    parts: part_id, scan_hours, recoat_hours, layer_count, height_mm, volume_mm3, correction_factor, time_warnings.
    """
    out = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("scan_hours").alias("scan_hours"),
        F.max_by("recoat_hours", F.struct("layer_count", -F.col("part_no"))).alias("recoat_hours"),
        F.max("layer_count").alias("layer_count"), F.max("height_mm").alias("height_mm"),
        F.sum("volume_mm3").alias("volume_mm3"), F.min_by("correction_factor", "part_no").alias("correction_factor"))
    notes = parts.select(*keys, F.explode("time_warnings").alias("_w")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("_w")).alias("warnings"))
    hours = F.col("scan_hours") + F.col("recoat_hours")
    return out.join(notes, list(keys), "left").select(
        "*", hours.alias("print_hours"), (hours / F.coalesce(F.nullif("correction_factor", F.lit(0.0)), F.lit(1.0))).alias("raw_print_hours"))
