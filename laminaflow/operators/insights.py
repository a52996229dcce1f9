"""Rules, hypotheses, draft insights and the production-context fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match
from laminaflow.operators.linking import asof_latest
from laminaflow.operators.ordered import Series

# Operator event type -> state column it refreshes.
STATE_COLUMNS = {
    "filter_replaced": "filter_state", "seal_replaced": "seal_state", "optics_cleaned": "optics_cleaning_state",
    "recoater_adjusted": "recoater_state", "chamber_cleaned": "chamber_cleaning_state",
    "calibration_performed": "calibration_state",
}
CONFIRMED = ["operator_confirmed", "supervisor_confirmed", "system_matched"]


class Rules:
    """Registry of rules over a facts row: id -> function of nothing returning a result struct column."""

    def __init__(self) -> None:
        self._rules: dict[str, Callable[[], Column]] = {}

    def register(self, rule_id: str, build: Callable[[], Column]) -> None:
        self._rules[rule_id] = build

    def run(self, facts: DataFrame, key: str = "session_id") -> DataFrame:
        """One row per (facts row, rule)."""
        results = F.array(*[F.struct(F.lit(i).alias("rule_id"), b().alias("r")) for i, b in self._rules.items()])
        return facts.select(key, F.explode(results).alias("_x")).select(key, "_x.rule_id", "_x.r.*")


def rule_result(matched: Column, severity: str, confidence: Column, message: Column) -> Column:
    hit = F.coalesce(matched, F.lit(False))
    return F.struct(hit.alias("matched"), F.when(hit, severity).otherwise("info").alias("severity"),
                    F.when(hit, confidence).otherwise(0.0).alias("confidence"), message.alias("message"))


def default_rules() -> Rules:
    rules = Rules()

    def restart_chain() -> Column:
        n = F.coalesce("restart_attempt_count", F.lit(0))
        return rule_result(n >= 2, "warning", F.least(0.4 + n * 0.1, F.lit(0.9)), F.when(
            n >= 2, F.concat(n.cast("string"), F.lit(" restart attempts detected."))).otherwise("No restart chain."))

    def missing_context() -> Column:
        names = ("material", "powder_batch", "gas_cylinder_id")
        gaps = F.filter(F.array(*[F.when(F.nullif(F.col(f), F.lit("")).isNull(), F.lit(f)) for f in names]), lambda x: x.isNotNull())
        some = F.size(gaps) > 0
        return rule_result(some, "warning", F.lit(1.0), F.when(
            some, F.concat(F.lit("Missing production context: "), F.concat_ws(", ", gaps))).otherwise("Production context present."))

    rules.register("restart_chain_detected", restart_chain)
    rules.register("missing_production_context", missing_context)
    return rules


def hypothesis_score(sample: Column, effect: Column, quality: Column, missing_penalty: Column | float = 0.0,
                     counterexamples: Column | int = 0) -> tuple[Column, Column]:
    """(status, confidence) of a hypothesis."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    base = F.least(F.abs(effect), F.lit(1.0)) * 0.45 + quality * 0.45
    penalty = F.least(as_col(counterexamples) * 0.08 + as_col(missing_penalty), F.lit(0.5))
    full = F.greatest(F.lit(0.0), F.least(base - penalty, F.lit(0.95)))
    confidence = first_match([(sample < 3, F.least(F.lit(0.25), quality)), (sample < 10, F.least(full, F.lit(0.55)))], full)
    status = first_match([(sample < 3, "observation"), (sample < 10, "weak_hypothesis")], "candidate_insight")
    return status, confidence


def candidate_hypotheses(edges: DataFrame, sample: Column, quality: Column, missing_penalty: Column | float = 0.0,
                         counterexamples: Column | int = 0) -> DataFrame:
    """Operator event directly followed by an anomaly, scored."""
    status, confidence = hypothesis_score(sample, F.lit(0.3), quality, missing_penalty, counterexamples)
    return edges.where("source_kind = 'operator_event' and target_kind = 'anomaly'").select(
        "*", F.lit("Operator context precedes anomaly").alias("title"), status.alias("status"), confidence.alias("confidence"))


def pattern_hypotheses(patterns: DataFrame, features: DataFrame) -> DataFrame:
    """Score of each repeated pattern against the number of sessions looked at."""
    sample = features.agg(F.count(F.lit(1)).alias("sample_size"))
    df = patterns.crossJoin(F.broadcast(sample))  # one-row aggregate
    n = F.col("sample_size")
    effect = F.least(F.col("count") / F.greatest(n, F.lit(1)), F.lit(1.0))
    status, confidence = hypothesis_score(n, effect, F.when(n < 10, 0.45).otherwise(0.7), 0.15)
    return df.select("pattern", "count", "sample_size", F.concat(F.lit("Recurring pattern: "), "pattern").alias("title"),
                     status.alias("status"), confidence.alias("confidence"))


def insight_drafts(hypotheses: DataFrame) -> DataFrame:
    """Draft insights, all waiting for a human."""
    return hypotheses.select(
        "title", F.lit("recurring_pattern").alias("insight_type"), "sample_size", "confidence",
        F.lit("needs_review").alias("status"),
        F.lit("Draft insight generated by bounded historical analysis; requires human review.").alias("description"))


def reanalysis_verdict(features: DataFrame, drafts: DataFrame) -> DataFrame:
    """One verdict row for a reanalysis run."""
    n = features.agg(F.count(F.lit(1)).alias("n"))
    d = drafts.agg(F.count(F.lit(1)).alias("insights"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"))
    status = F.when(F.col("n") == 0, "insufficient_data").otherwise("completed")
    verdict = first_match([(F.col("n") == 0, "insufficient_data"), (F.col("insights") == 0, "no_new_pattern")], "weak_signal_found")
    return n.crossJoin(d).select(status.alias("status"), verdict.alias("verdict"), "confidence", "insights")


def context_changes(events: DataFrame, keys: Sequence[str] = ("printer_id",)) -> DataFrame:
    """Confirmed operator events as one row per context field set: field, value, previous value, conflict flag."""
    ok = events.where(F.col("verification_status").isin(*CONFIRMED))
    kind, state = F.col("event_type"), first_match([(F.col("event_type") == t, s) for t, s in STATE_COLUMNS.items()])
    pair = lambda name, value: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("field"), value.alias("value"))
    sets = F.array(
        pair("material", F.col("material")), pair("powder_batch", F.col("powder_batch")), pair("gas_type", F.col("gas_type")),
        pair("gas_cylinder_id", F.col("gas_cylinder_id")),
        pair("powder_reuse_count", F.when(F.col("unit") == "reuse_cycle", F.floor(F.col("value").try_cast("double")).cast("string"))),
        pair(state, F.when(state.isNotNull(), F.concat_ws("@", kind, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")))),
        pair("gas_pressure", F.when((kind == "gas_cylinder_replaced") & (F.col("value") != ""), F.concat_ws(" ", "value", "unit"))))
    long = ok.select(*keys, "timestamp", "event_id", "event_type", F.inline(sets)).where("value is not null and value <> ''")
    s = Series(long, [*keys, "field"], ["timestamp", "event_id"]).with_prev(previous="value")
    return s.frame.withColumn("conflict", F.col("previous").isNotNull() & (F.col("previous") != F.col("value")))


def context_state(changes: DataFrame, keys: Sequence[str] = ("printer_id",)) -> DataFrame:
    """Context after all events: last value per field."""
    return changes.groupBy(*keys, "field").agg(
        F.max_by("value", F.struct("timestamp", "event_id")).alias("value"), F.max("timestamp").alias("updated_at"),
        F.count_if("conflict").alias("conflicts"))


def context_intervals(changes: DataFrame, keys: Sequence[str] = ("printer_id",)) -> DataFrame:
    """Validity interval of every context value (open at the end for the current one)."""
    s = Series(changes, [*keys, "field"], ["timestamp", "event_id"]).with_next(valid_to="timestamp")
    return s.frame.select(*keys, "field", "value", F.col("timestamp").alias("valid_from"), "valid_to")


def context_at_start(sessions: DataFrame, events: DataFrame, keys: Sequence[str] = ("printer_id",)) -> DataFrame:
    """Context in force at each session start, and the age in hours of every maintained state."""
    plain = ["material", "powder_batch", "gas_cylinder_id", "gas_type"]
    facts = events.where(F.col("verification_status").isin(*CONFIRMED)).select(
        *keys, "timestamp", "event_id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in plain],
        F.when(F.col("unit") == "reuse_cycle", F.floor(F.col("value").try_cast("double")).cast("long")).alias("powder_reuse_count"),
        *[F.when(F.col("event_type") == t, F.lit(1)).alias(s) for t, s in STATE_COLUMNS.items()])
    states = list(STATE_COLUMNS.values())
    out = asof_latest(sessions, facts, keys, "start_ts", "timestamp", [*plain, "powder_reuse_count", *states], ["event_id"])
    age = lambda s: ((F.unix_micros("start_ts") - F.unix_micros(f"{s}_at")) / F.lit(3.6e9)).alias(f"{s}_age_hours")
    return out.select(*sessions.columns, *plain, "powder_reuse_count", *[age(s) for s in states])
