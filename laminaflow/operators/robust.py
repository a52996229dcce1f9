"""Robust and ordered statistics per key: z-scores, spikes, slopes, samples, previews."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminaflow.functions.scalars import even_pick, finite
from laminaflow.model import PRIORITY_EVENT_TYPES
from laminaflow.operators.ordered import Series, group_medians, median_of_array


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: med, mad."""
    med = group_medians(df, keys, value, "med")
    spread = df.where(F.col(value).isNotNull()).join(med, list(keys)).select(
        *keys, "med", F.abs(F.col(value) - F.col("med")).alias("_dev"))
    return group_medians(spread, [*keys, "med"], "_dev", "mad")


def robust_z(df: DataFrame, keys: Sequence[str], value: str, name: str = "robust_z") -> DataFrame:
    """Modified z-score 0.6745*(x-med)/MAD per row; 0 where the MAD is 0."""
    out = df.join(median_and_mad(df, keys, value), list(keys), "left")
    z = F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * (F.col(value) - F.col("med")) / F.col("mad"))
    return out.withColumn(name, z)


def z_score(df: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Classical z-score with population deviation; 0 for a single value or no spread."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    flat = F.coalesce(F.col("_s"), F.lit(0.0)) == 0
    out = df.join(stats, list(keys), "left")
    return out.withColumn(name, F.when(flat, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int = 7,
                   name: str = "baseline") -> DataFrame:
    """Median of the previous ``size`` values, null on the first row."""
    out = Series(df, keys, order).with_previous_values("_before", value, size).frame
    return out.withColumn(name, median_of_array(F.col("_before"))).drop("_before")


def robust_spike(df: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """Farthest value from the median per key (n >= 5) and its score; keys without any spread drop out.

    Scale: MAD; when that is 0 the deviation of all points but the farthest; when that is 0 too a lone
    different value scores 99.
    """
    keys = list(keys)
    clean = df.where(finite(F.col(value)))
    stats = median_and_mad(clean, keys, value)
    dev = clean.join(stats, keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    peak = dev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("med").alias("med"), F.first("mad").alias("mad"),
        F.max(value).alias("max_value"),
        F.max_by(F.struct(F.col(idx).alias("peak_idx"), F.col(value).alias("peak")),
                 F.struct("_d", -F.col(idx))).alias("_p"),
        F.max_by(idx, F.struct("_d", F.col(idx))).alias("_drop"))
    peak = peak.where("n >= 5").select(*keys, "n", "med", "mad", "max_value", "_drop", "_p.*")
    flat = peak.where("mad = 0").select(*keys, "_drop")
    rest = clean.join(flat, keys).where(F.col(idx) != F.col("_drop")).groupBy(*keys).agg(
        F.stddev_pop(value).alias("_rest"))
    off = F.col("peak") - F.col("med")
    z = (F.when(F.col("mad") > 0, 0.6745 * off / F.col("mad"))
         .when(F.col("_rest") > 0, off / F.col("_rest"))
         .when(off != 0, 99.0))
    return peak.join(rest, keys, "left").withColumn("z_score", z).where("z_score is not null").drop("_drop", "_rest")


@F.pandas_udf(T.DoubleType())
def _pair_slope_median(xs: pd.Series, ys: pd.Series) -> pd.Series:
    def one(x, y) -> float:
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        if x.size < 2:
            return 0.0
        i, j = np.triu_indices(x.size, 1)
        run = x[j] - x[i]
        ok = run != 0
        return float(np.median((y[j] - y[i])[ok] / run[ok])) if ok.any() else 0.0
    return pd.Series([one(x, y) for x, y in zip(xs, ys)])


def position_slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "slope") -> DataFrame:
    """Least-squares slope of all values per key against the row position (with n); 0 for fewer than two rows.

    The sums combine before the shuffle, so a series of any length is used whole.
    """
    keys = list(keys)
    s = Series(df.where(F.col(value).isNotNull()), keys, order).with_row_number("_rn")
    slope = F.regr_slope(F.col(value).cast("double"), F.col("_rn").cast("double"))
    return s.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(slope, F.lit(0.0)).alias(name))


def theil_sen(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, max_points: int, name: str = "slope") -> DataFrame:
    """Median of the pairwise slopes of ``max_points`` evenly spread rows per key against the row position.

    A robust slope of a sample by name: ``n`` counts the rows of the series, ``n_used`` those that take part. 0 for fewer
    than two rows. One group ships at most ``max_points`` (position, value) pairs to Python, and pairs never exist as rows.
    """
    keys = list(keys)
    s = Series(df.where(F.col(value).isNotNull()), keys, order).with_row_number("_rn").with_count("_n")
    rows = s.frame.select(*keys, (F.col("_rn") - 1).alias("_i"), "_n", F.col(value).cast("double").alias("_v"))
    rows = rows.where(even_pick(F.col("_i"), F.col("_n"), max_points))
    packed = rows.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.count(F.lit(1)).alias("n_used"), F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
    return packed.select(*keys, "n", "n_used", _pair_slope_median(
        F.transform("_p", lambda p: p["_i"].cast("double")), F.transform("_p", lambda p: p["_v"])).alias(name))


def stride_slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                 name: str = "trend_slope") -> DataFrame:
    """Cheap slope: median of the steps between every (n div 20)-th value in time order."""
    keys = list(keys)
    s = Series(df, keys, order).with_row_number("_rn").with_count("_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / 20))
    rows = s.frame.select(*keys, (F.col("_rn") - 1).alias("_i"), "_n", step.alias("_step"), F.col(value).alias("_v"))
    # at most ~40 rows per key survive, so the rest of the work is on bounded groups
    rows = rows.where(F.col("_i") % F.col("_step") == 0).groupBy(*keys).agg(
        F.first("_step").alias("_step"), F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda k: (
        F.get("_p", k)["_v"] - F.get("_p", k - 1)["_v"]) / F.col("_step"))
    return rows.select(*keys, F.when(F.size("_p") > 1, median_of_array(steps)).otherwise(0.0).alias(name))


def even_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 150) -> DataFrame:
    """Up to ``limit`` rows per key spread evenly over the whole series (adds idx, n)."""
    s = Series(df, keys, order).with_row_number("_rn").with_count("n")
    out = s.frame.withColumn("idx", F.col("_rn") - 1).drop("_rn")
    return out.where(even_pick(F.col("idx"), F.col("n"), limit, step_first=False))


def step_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 150) -> DataFrame:
    """Rows at floor(i*n/limit), i < limit; everything when the series is short enough."""
    s = Series(df, keys, order).with_row_number("_rn").with_count("n")
    out = s.frame.withColumn("idx", F.col("_rn") - 1).drop("_rn")
    ratio = F.col("n") / F.lit(float(limit))
    near = F.floor(F.col("idx") / ratio)
    def lands(i: Column) -> Column:
        return (i < limit) & (F.floor(i * ratio) == F.col("idx"))
    return out.where((F.col("n") <= limit) | lands(near) | lands(near + 1))


def timeline_preview(events: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int = 2000,
                     head: int = 200, priority: Sequence[str] = tuple(PRIORITY_EVENT_TYPES)) -> DataFrame:
    """Bounded preview: first rows, every priority event, an even stride of the rest; ``shown_as`` says why.

    A shortened key gets one extra ``_truncated`` row that carries the full count.
    """
    keys = list(keys)
    urgent = F.coalesce(F.col("event_type").isin(*priority), F.lit(False))
    s = Series(events, keys, order).with_row_number("_rn").with_count("_n")
    other = (F.col("_rn") > head) & ~urgent
    s = s.with_column("_other", other.cast("long")).with_running_sum("_k", F.col("_other"))
    totals = s.frame.groupBy(*keys).agg(
        F.sum("_other").alias("_others"), F.count_if((F.col("_rn") > head) & urgent).alias("_urgent"))
    df = s.frame.join(totals, keys)
    budget = F.lit(cap) - head - F.col("_urgent")
    step = F.greatest(F.lit(1), F.floor(F.col("_others") / budget))
    at = F.col("_k") - 1
    sampled = (F.col("_other") == 1) & (budget > 0) & (at % step == 0) & (at / step < budget)
    shown = (F.when(F.col("_n") <= cap, "all").when(F.col("_rn") <= head, "head")
             .when(urgent, "priority").when(sampled, "sample"))
    kept = df.withColumn("shown_as", shown).where("shown_as is not null")
    kept = kept.withColumn("total_events", F.col("_n")).drop("_rn", "_n", "_other", "_k", "_others", "_urgent")
    long_keys = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_events")).where(F.col("total_events") > cap)
    marker = long_keys.select(*keys, "total_events", F.lit("_truncated").alias("event_type"),
                              F.lit("marker").alias("shown_as"))
    return kept.unionByName(marker, allowMissingColumns=True)
