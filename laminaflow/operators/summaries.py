"""Fixed summary queries over sessions, operator events and outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match
from laminaflow.model import GAS_EVENT_TYPES, MAINTENANCE_TYPES, POWDER_EVENT_TYPES
from laminaflow.operators.linking import in_sessions, last_sessions


def _number() -> Column:
    return F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))


def _per_session(total: Column) -> Column:
    return total / F.greatest(F.col("sessions_analyzed"), F.lit(1))


def _analyzed(summary: DataFrame, sessions: DataFrame) -> DataFrame:
    # two single-row aggregates side by side
    return summary.crossJoin(sessions.agg(F.count(F.lit(1)).alias("sessions_analyzed")))


def gas_summary(sessions: DataFrame, operator_events: DataFrame, last_n: int = 10) -> DataFrame:
    recent = last_sessions(sessions, last_n)
    rows = in_sessions(operator_events.where(F.col("event_type").isin(*GAS_EVENT_TYPES)), recent)
    used = (F.col("event_type") == "gas_consumption_recorded") & F.col("unit").isin("bar", "бар")
    out = rows.agg(
        F.coalesce(F.sum(F.when(used, _number())), F.lit(0.0)).alias("total_consumed_bar"),
        F.count_if(F.col("event_type") == "gas_cylinder_replaced").alias("cylinder_changes"),
        F.count_if(F.col("event_type") == "gas_consumption_recorded").alias("consumption_records"),
        F.array_sort(F.collect_set(F.nullif("gas_cylinder_id", F.lit("")))).alias("cylinders_used"))
    return _analyzed(out, recent).withColumn("avg_per_session_bar", _per_session(F.col("total_consumed_bar")))


def powder_summary(sessions: DataFrame, operator_events: DataFrame, last_n: int = 10) -> DataFrame:
    recent = last_sessions(sessions, last_n)
    rows = in_sessions(operator_events.where(F.col("event_type").isin(*POWDER_EVENT_TYPES)), recent)
    used = (F.col("event_type") == "powder_consumption_recorded") & (F.col("unit") == "kg")
    reused = F.col("event_type") == "powder_reused"
    out = rows.agg(
        F.coalesce(F.sum(F.when(used, _number())), F.lit(0.0)).alias("total_consumed_kg"),
        F.array_sort(F.collect_set(F.nullif("powder_batch", F.lit("")))).alias("batches_used"),
        F.count_if(reused).alias("reuse_events"),
        F.coalesce(F.max(F.when(reused, F.floor(_number()).cast("long"))), F.lit(0)).alias("max_reuse_cycle"))
    return _analyzed(out, recent).withColumn("avg_per_session_kg", _per_session(F.col("total_consumed_kg")))


def quality_summary(sessions: DataFrame, outcomes: DataFrame, last_n: int = 10) -> DataFrame:
    recent = last_sessions(sessions, last_n)
    rows = in_sessions(outcomes, recent)
    of = lambda r: F.count_if(F.col("result") == r)
    out = rows.agg(F.count(F.lit(1)).alias("total_outcomes"), of("accepted").alias("accepted"),
                   of("rejected").alias("rejected"), of("warning").alias("warnings"))
    share = lambda c: F.col(c) / F.greatest(F.col("total_outcomes"), F.lit(1)) * 100
    return _analyzed(out, recent).select("*", share("accepted").alias("accepted_pct"), share("rejected").alias("rejected_pct"))


def defect_histogram(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.nullif("defect_type", F.lit("")).isNotNull()).groupBy("defect_type").agg(
        F.count(F.lit(1)).alias("n"))


def tolerance_violations(features: DataFrame, rules: DataFrame, columns: Sequence[str], key: str = "session_id") -> DataFrame:
    """Feature values outside the learned range of their active rule."""
    long = features.unpivot([key], list(columns), "feature", "value").where("value is not null")
    active = F.broadcast(rules.where("is_active").select(F.col("feature_name").alias("feature"), "min_value", "max_value"))
    reason = first_match([(F.col("value") < F.col("min_value"), "below_learned_tolerance"),
                          (F.col("value") > F.col("max_value"), "above_learned_tolerance")])
    return long.join(active, "feature").select(key, "feature", "value", "min_value", "max_value",
                                               reason.alias("reason")).where("reason is not null")


def learn_tolerances(approved: DataFrame, columns: Sequence[str], order: Sequence[str], rules: DataFrame | None = None,
                     key: str = "session_id") -> DataFrame:
    """Ranges after approving sessions in order.

    An existing rule only widens. Without one, the first approved value opens a range of +-max(5 %, 1), and the
    others widen it; min/max are order-free, so only the opening value needs the order.
    """
    long = approved.select(key, *order, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(dict.fromkeys([key, *order])), list(columns), "feature_name", "value").where("value is not null")
    place = F.struct(*order, key)
    seen = long.groupBy("feature_name").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min_by("value", place).alias("_v"),
        F.max_by(key, place).alias("session_id_reference"))
    margin = F.greatest(F.col("_v") * 0.05, F.lit(1.0))
    low, high = F.col("_v") - margin, F.col("_v") + margin
    if rules is not None:
        old = rules.where("is_active").select("feature_name", "min_value", "max_value", F.lit(True).alias("_old"))
        seen = seen.join(old, "feature_name", "left")
        low = F.when(F.col("_old"), F.col("min_value")).otherwise(low)
        high = F.when(F.col("_old"), F.col("max_value")).otherwise(high)
    return seen.select("feature_name", F.least(low, "_lo").alias("min_value"), F.greatest(high, "_hi").alias("max_value"),
                       "session_id_reference", F.lit(True).alias("is_active"))


def session_summary(sessions: DataFrame, rules: DataFrame, columns: Sequence[str], last_n: int = 10) -> DataFrame:
    """Newest sessions with the number of tolerance violations."""
    recent = last_sessions(sessions, last_n)
    bad = tolerance_violations(recent, rules, columns).groupBy("session_id").agg(F.count(F.lit(1)).alias("violations"))
    out = recent.join(bad, "session_id", "left")
    n = F.coalesce("violations", F.lit(0).cast("long"))
    return out.withColumn("violations", n).withColumn("is_within_norm", F.col("violations") == 0)


def repeated_patterns(features: DataFrame, columns: Sequence[str], min_count: int = 3, key: str = "session_id") -> DataFrame:
    """``name:value`` of positive ``*_count`` features seen in at least ``min_count`` sessions."""
    counts = [c for c in columns if c.endswith("_count")]
    long = features.select(key, *[F.col(c).cast("long").alias(c) for c in counts]).unpivot([key], counts, "name", "value")
    return long.where("value > 0").groupBy("name", "value").agg(F.count(F.lit(1)).alias("count")).where(
        F.col("count") >= min_count).select(
        F.concat_ws(":", "name", F.col("value").cast("string")).alias("pattern"), "name", "value", "count")


def pattern_support(features: DataFrame, patterns: DataFrame, columns: Sequence[str], key: str = "session_id") -> DataFrame:
    """One row per (pattern, supporting session): the support list in long form, so a common pattern stays spread."""
    counts = [c for c in columns if c.endswith("_count")]
    long = features.select(key, *[F.col(c).cast("long").alias(c) for c in counts]).unpivot([key], counts, "name", "value")
    return long.join(patterns.select("name", "value", "pattern"), ["name", "value"]).select("pattern", key)


def entity_counts(entities: dict[str, DataFrame]) -> DataFrame:
    """Row count of every entity, one row each."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in entities.items()]
    return reduce(DataFrame.unionByName, parts)


def dashboard_totals(sessions: DataFrame, operator_events: DataFrame) -> DataFrame:
    """Global counters of the overview page."""
    number = F.col("value").try_cast("double")
    s = sessions.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("classification") == "REAL_PRINT").alias("prints"),
                     F.floor(F.sum("duration_min") / 60).alias("hours"), F.sum("total_lines").alias("lines"))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, number)), F.lit(0.0))
    e = operator_events.agg(of("gas_consumption_recorded").alias("gas_total"), of("powder_consumption_recorded").alias("powder_total"))
    return s.crossJoin(e)


def counts_by(df: DataFrame, column: str, null_name: str | None = None) -> DataFrame:
    col = F.col(column)
    rows = df.where(col.isNotNull()) if null_name is None else df
    col = col if null_name is None else F.coalesce(F.nullif(col, F.lit("")), F.lit(null_name))
    return rows.groupBy(col.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def historical_rate(sessions: DataFrame, min_minutes: float = 10.0) -> DataFrame:
    return sessions.where(F.col("duration_min") > min_minutes).agg(
        F.count(F.lit(1)).alias("sessions_used"), F.avg("duration_min").alias("avg_duration_min"))


def richest_latest(sessions: DataFrame) -> DataFrame:
    """Real print with most telemetry points of all sessions (ties: the newer one)."""
    pool = sessions.where("classification = 'REAL_PRINT' and telemetry_points > 0")
    return pool.agg(F.max_by(F.struct("session_id", "start_ts", "telemetry_points"),
                             F.struct("telemetry_points", "start_ts")).alias("_b")).select("_b.*")


def consumption_listing(operator_events: DataFrame, event_type: str, label: str, skip: int, limit: int) -> DataFrame:
    rows = operator_events.where(F.col("event_type") == event_type).orderBy("timestamp", "event_id")
    return rows.offset(skip).limit(limit).select("timestamp", F.col("value").try_cast("double").alias("value"), label, "session_id")


def session_kpis(overview: DataFrame, classes: DataFrame, quality: DataFrame) -> DataFrame:
    """One display row per session; page it with ``query.page``."""
    return (overview.join(classes, "session_id", "left")
            .join(quality.select("session_id", F.col("score").alias("data_quality_score"),
                                 F.col("grade").alias("data_quality_grade"), "issue_count"), "session_id", "left")
            .withColumn("date", F.replace(F.col("session_id"), F.lit("session_"), F.lit(""))))


def maintenance_events(operator_events: DataFrame) -> DataFrame:
    return operator_events.where(F.col("event_type").isin(*MAINTENANCE_TYPES))


def missing_context(features: DataFrame, fields: Sequence[str] = ("material", "powder_batch", "gas_cylinder_id")) -> DataFrame:
    """One question per unset context field of a session."""
    gaps = F.filter(F.array(*[F.when(F.nullif(F.col(f), F.lit("")).isNull(), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    out = features.select("session_id", F.explode(gaps).alias("field"))
    return out.withColumn("question", F.format_string("Please confirm %s for session %s.", "field", F.col("session_id").cast("string")))


def newest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), "session_id").limit(1)
