"""Data-quality checks of a session and their score. Every check returns the same issue columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match, grade, seconds_between
from laminaflow.model import EXPECTED_FAMILIES, QUALITY_PENALTIES
from laminaflow.operators.ordered import Series, group_medians

ISSUE = ["session_id", "kind", "severity", "count", "detail"]


def _issue(df: DataFrame, kind: str, severity: Column | str, count: Column, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("session_id", F.lit(kind).alias("kind"), severity.alias("severity"),
                     count.cast("long").alias("count"), detail.alias("detail"))


def layer_gaps(events: DataFrame) -> DataFrame:
    """Missing layers inside the printed range; keeps sessions at or above 2 %."""
    layers = events.where("layer >= 0").select("session_id", "layer").distinct()
    runs = Series(layers, ["session_id"], ["layer"]).with_next(_next="layer").frame
    out = runs.groupBy("session_id").agg(
        F.min("layer").alias("layer_min"), F.max("layer").alias("layer_max"), F.count(F.lit(1)).alias("present"),
        F.max(F.col("_next") - F.col("layer") - 1).alias("largest_gap"))
    span = F.col("layer_max") - F.col("layer_min") + 1
    missing = span - F.col("present")
    return out.withColumn("missing", missing.cast("long")).withColumn("fraction", missing / span).where(
        "present >= 2 and missing > 0 and fraction >= 0.02").withColumn(
        "severity", F.when(F.col("fraction") > 0.1, "high").otherwise("medium"))


def time_gaps(stamps: DataFrame, tie: Sequence[str] = (), minutes: float = 30.0) -> DataFrame:
    """Recording gaps between neighbouring stamps. stamps(session_id, ts), daemon log left out by the caller."""
    s = Series(stamps.where("ts is not null"), ["session_id"], ["ts", *tie]).with_next(_next="ts")
    gaps = s.frame.withColumn("_gap", seconds_between(F.col("ts"), F.col("_next")))
    wide = F.col("_gap") > minutes * 60
    out = gaps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("stamps"), F.count_if(wide).alias("gaps"), (F.max("_gap") / 60).alias("max_gap_min"),
        F.max_by(F.struct(F.col("ts").alias("gap_start"), F.col("_next").alias("gap_end")),
                 F.when(wide, F.struct("_gap", -F.unix_micros("ts")))).alias("_w"))
    out = out.where("stamps >= 3 and gaps > 0")
    return out.select("session_id", "gaps", "max_gap_min", "_w.*",
                      F.when(F.col("max_gap_min") > 120, "high").otherwise("medium").alias("severity"))


def sensor_faults(stats: DataFrame) -> DataFrame:
    """Frozen or dropped-out sensors: (session_id, signal, fault). stats(session_id, signal, n, std)."""
    med = group_medians(stats, ["session_id"], "n", "median_n")
    fault = first_match([
        ((F.col("n") >= 50) & (F.col("std") == 0), "sensor_stuck"),
        ((F.col("median_n") > 0) & (F.col("n") < F.col("median_n") * 0.5), "sensor_dropout")])
    return stats.join(med, "session_id").select("session_id", "signal", fault.alias("fault")).where("fault is not null")


def parse_warnings(tables: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Malformed rows, distinct unknown columns, distinct warning codes; count = first of the three that is not 0.

    tables(session_id, malformed_rows, unknown_columns), diagnostics(session_id, severity, code).
    """
    rows = tables.groupBy("session_id").agg(F.sum("malformed_rows").alias("malformed"))
    unknown = tables.select("session_id", F.explode("unknown_columns").alias("column")).groupBy("session_id").agg(
        F.array_sort(F.collect_set("column")).alias("unknown_columns"))
    codes = diagnostics.where("severity in ('warning', 'error')").groupBy("session_id").agg(
        F.array_sort(F.collect_set(F.coalesce(F.nullif("code", F.lit("")), F.lit("unknown")))).alias("codes"))
    df = rows.join(unknown, "session_id", "full").join(codes, "session_id", "full")
    nothing = F.array().cast("array<string>")
    df = df.select("session_id", F.coalesce("malformed", F.lit(0)).alias("malformed"),
                   F.coalesce("unknown_columns", nothing).alias("unknown_columns"),
                   F.coalesce("codes", nothing).alias("codes"))
    first = F.coalesce(F.nullif("malformed", F.lit(0)), F.nullif(F.size("unknown_columns"), F.lit(0)),
                       F.nullif(F.size("codes"), F.lit(0)))
    return df.withColumn("count", first.cast("long")).where("count is not null")


def missing_families(files: DataFrame, expected: Sequence[str] = tuple(EXPECTED_FAMILIES)) -> DataFrame:
    """Expected families absent from a session that has at least two of them."""
    wanted = F.array(*[F.lit(f) for f in expected])
    present = files.groupBy("session_id").agg(F.collect_set("family").alias("present"))
    absent = F.array_sort(F.array_except(wanted, F.col("present")))
    out = present.where(F.size(F.array_intersect("present", wanted)) >= 2).withColumn("missing", absent)
    return out.where(F.size("missing") > 0).select(
        "session_id", "missing", F.when(F.size("missing") > 1, "high").otherwise("medium").alias("severity"))


def session_issues(files: DataFrame, events: DataFrame, stamps: DataFrame, stats: DataFrame,
                   tables: DataFrame | None = None, diagnostics: DataFrame | None = None) -> DataFrame:
    """All issues in long form: session_id, kind, severity, count, detail."""
    families = missing_families(files)
    layers, gaps = layer_gaps(events), time_gaps(stamps)
    faults = sensor_faults(stats).groupBy("session_id", "fault").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("signal")).alias("signals"))
    issues = [
        _issue(families, "missing_log_family", F.col("severity"), F.size("missing"), F.concat_ws(", ", "missing")),
        _issue(layers, "layer_gaps", F.col("severity"), F.col("missing"),
               F.concat_ws("-", F.col("layer_min").cast("string"), F.col("layer_max").cast("string"))),
        _issue(gaps, "time_gaps", F.col("severity"), F.col("gaps"), F.date_format("gap_start", "yyyy-MM-dd HH:mm:ss")),
        faults.select("session_id", F.col("fault").alias("kind"), F.lit("medium").alias("severity"),
                      F.col("n").alias("count"), F.concat_ws(", ", "signals").alias("detail")),
    ]
    if tables is not None and diagnostics is not None:
        warned = parse_warnings(tables, diagnostics)
        issues.append(_issue(warned, "parse_warnings", "low", F.col("count"), F.concat_ws(", ", "codes")))
    return reduce(DataFrame.unionByName, issues)


def quality_score(sessions: DataFrame, issues: DataFrame) -> DataFrame:
    """100 minus the amplified penalties, floored at 0, for every session."""
    base = first_match([(F.col("kind") == k, p) for k, p in QUALITY_PENALTIES.items()], 5.0)
    amp = F.least(F.lit(2.0), 1 + F.log10(F.greatest(F.lit(1), F.col("count")).cast("double")))
    lost = issues.groupBy("session_id").agg(F.sum(base * amp).alias("_lost"), F.count(F.lit(1)).alias("issue_count"))
    df = sessions.select("session_id").distinct().join(lost, "session_id", "left")
    score = F.greatest(F.lit(0.0), 100 - F.coalesce("_lost", F.lit(0.0)))
    return df.select("session_id", score.alias("score"), grade(F.round(score, 9), 85, 60).alias("grade"),
                     F.coalesce("issue_count", F.lit(0).cast("long")).alias("issue_count"))


def report_quality(files: DataFrame, tables: DataFrame) -> DataFrame:
    """Report block per session: files, empty files, malformed rows, repeated headers."""
    f = files.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if(F.col("size_bytes") == 0).alias("empty_file_count"))
    t = tables.groupBy("session_id").agg(F.sum("malformed_rows").alias("malformed_rows"),
                                         F.sum("repeated_headers").alias("repeated_headers"))
    return f.join(t, "session_id", "left").fillna(0, ["malformed_rows", "repeated_headers"])


def quality_context(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals with coverage, and the defect histogram (null counted as none)."""
    of = lambda r: F.count_if(F.col("result") == r)
    totals = outcomes.agg(F.count(F.lit(1)).alias("quality_outcome_count"), of("rejected").alias("rejected_count"),
                          of("warning").alias("warning_count"),
                          F.when(F.count(F.lit(1)) > 0, 1.0).otherwise(0.0).alias("coverage"))
    defect = F.coalesce(F.nullif("defect_type", F.lit("")), F.lit("none"))
    return totals, outcomes.groupBy(defect.alias("defect_type")).agg(F.count(F.lit(1)).alias("n"))
