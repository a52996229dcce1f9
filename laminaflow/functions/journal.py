"""Operator free text -> structured journal fields, as one projection over a message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match, matched

# Field patterns of operator messages.
CYLINDER = r"(?iu)(?:баллон|cylinder)\s*([A-Za-zА-Яа-я0-9_-]+)"
PRESSURE = r"(?iu)(\d+(?:[.,]\d+)?)\s*(бар|bar|atm|атм)"
LAYER = r"(?iu)(?:сло[йяеё]|layer)\s*[№#]?\s*(\d+)"
BATCH = r"(?iu)(?:партия[_\-\s]*([A-Za-zА-Яа-я0-9_-]+)|(batch[_\-\s]*[A-Za-zА-Яа-я0-9_-]+))"
MATERIAL = r"(?iuU)\b(AlSi10Mg|AlSi ?10Mg|316L|Ti6Al4V|Inconel ?718|сталь|титан|алюмин(?:ий|ия|иев))\b"
REMAINING = r"(?iu)(?:остаток|осталось|ост\.?)\s*[:=]?\s*(\d+(?:[.,]\d+)?)"
CONSUMED = r"(?iu)(?:потрач|израсход|использов|расход|потрачено)\s*[:=]?\s*(\d+(?:[.,]\d+)?)"
WEIGHT = r"(?iu)(\d+(?:[.,]\d+)?)\s*(кг|kg|грамм|g)"
REUSE_CYCLE = r"(?iu)(?:цикл|reuse cycle)\s*(\d+)|(\d+)\s*цикл"

# Topic words, in the order they are tried.
TOPICS = [
    ("gas", r"(?iu)баллон|argon|аргон|газ"),
    ("powder", r"(?iu)порош|powder"),
    ("service", r"(?iu)уплотн|filter|фильтр|оптик|камер|рекот|калибр"),
    ("restart", r"(?iu)рестарт|restart"),
    ("accepted", r"(?iu)принята|accepted|годн"),
    ("defect", r"(?iu)забрак|rejected|дефект|пор"),
]
# Service word -> component, event type.
SERVICES = [
    ("уплотн", "seal", "seal_replaced"),
    ("фильтр|filter", "filter", "filter_replaced"),
    ("оптик", "optics", "optics_cleaned"),
    ("камер", "chamber", "chamber_cleaned"),
    ("рекот", "recoater", "recoater_adjusted"),
    ("калибр", "calibration", "calibration_performed"),
]
# Powder word -> event type when no amount is given.
POWDER_ACTIONS = [
    ("сито|просе", "powder_sieved"), ("суш", "powder_dried"), ("цикл|reuse|повтор", "powder_reused"),
]


def plain_number(text: Column) -> Column:
    """Decimal text without a needless fraction: 2,50 -> 2.5, 150.0 -> 150."""
    value = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    whole = value == F.floor(value)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def parse_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds the journal fields to a message table (original columns kept)."""
    note = F.trim(F.col(text))
    df = messages.withColumn("note", note)
    note = F.col("note")
    topic = first_match([(note.rlike(p), name) for name, p in TOPICS], "other")
    df = df.withColumn("_topic", topic)
    topic = F.col("_topic")
    amount = {k: plain_number(matched(note, p)) for k, p in
              {"remaining": REMAINING, "consumed": CONSUMED, "weight": WEIGHT, "pressure": PRESSURE}.items()}
    grams = F.lower(matched(note, WEIGHT, 2)).isin("грамм", "g")
    names = F.regexp_extract_all(note, F.lit(CYLINDER), F.lit(1))
    df = df.select(
        "*",
        *[v.alias(f"_{k}") for k, v in amount.items()],
        F.when(grams, (amount["weight"].try_cast("double") / 1000).cast("string"))
        .otherwise(amount["weight"]).alias("_kg"),
        F.lower(matched(note, PRESSURE, 2)).alias("_pressure_unit"),
        F.try_element_at(F.filter(names, lambda c: c.rlike(r"\d")), F.lit(-1)).alias("_cylinder"),
        F.coalesce(matched(note, BATCH, 1), matched(note, BATCH, 2)).alias("_batch"),
        F.coalesce(matched(note, REUSE_CYCLE, 1), matched(note, REUSE_CYCLE, 2)).alias("_cycle"),
        matched(note, LAYER).try_cast("int").alias("_layer"),
        matched(note, MATERIAL).alias("material"))
    gas, powder = topic == "gas", topic == "powder"
    used = F.col("_consumed").isNotNull() | F.col("_weight").isNotNull()
    service = first_match([(note.rlike("(?iu)" + w), t) for w, _, t in SERVICES])
    part = first_match([(note.rlike("(?iu)" + w), c) for w, c, _ in SERVICES])
    event_type = first_match([
        (gas & (F.col("_remaining").isNotNull() | F.col("_consumed").isNotNull()), "gas_consumption_recorded"),
        (gas & note.rlike("(?iu)нов|замен|постав"), "gas_cylinder_replaced"),
        (gas, "gas_pressure_issue"),
        (powder & used, "powder_consumption_recorded"),
        *[(powder & note.rlike("(?iu)" + w), t) for w, t in POWDER_ACTIONS],
        (powder, "powder_batch_changed"),
        (topic == "service", service),
        (topic == "restart", "restart_attempt"),
        (topic == "accepted", "part_accepted"),
        ((topic == "defect") & note.rlike("(?iu)забрак|rejected"), "part_rejected"),
        (topic == "defect", "visual_defect_found"),
    ], "operator_observation")
    df = df.withColumn("event_type", event_type)
    event_type = F.col("event_type")
    porous = (topic == "defect") & note.rlike("(?iu)пор")
    gas_use = gas & F.col("_remaining").isNull() & F.col("_consumed").isNotNull()
    gas_known = F.coalesce(F.col("_remaining"), F.col("_consumed"))
    reuse = (event_type == "powder_reused") & F.col("_cycle").isNotNull()
    value = first_match([
        (gas, F.coalesce(gas_known, F.col("_pressure"))),
        (powder & used, F.coalesce(F.col("_kg"), F.col("_consumed"))),
        (reuse, F.col("_cycle"))])
    unit = first_match([
        (gas & F.col("_remaining").isNotNull(), "bar_remaining"),
        (gas_use, "bar"),
        (gas, F.col("_pressure_unit")),
        (powder & used, "kg"),
        (reuse, "reuse_cycle")])
    action = first_match([
        (gas_use, "consumed"), (topic == "service", service), (topic == "restart", "manual_restart"),
        (porous, "porosity_observed")])
    def bonus(cond: Column, points: float) -> Column:
        return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    confidence = (
        F.lit(0.4)
        + bonus(gas & gas_known.isNotNull(), 0.30)
        + bonus(gas & F.col("_cylinder").isNotNull(), 0.25)
        + bonus(gas & gas_known.isNull() & F.col("_pressure").isNotNull(), 0.15)
        + bonus(powder & F.col("_consumed").isNotNull(), 0.30)
        + bonus(powder & F.col("_weight").isNotNull(), 0.30)
        + bonus(powder & F.col("_batch").isNotNull(), 0.25)
        + bonus(topic == "service", 0.30)
        + bonus((topic == "restart") & F.col("_layer").isNotNull(), 0.25)
        + bonus(topic == "accepted", 0.25)
        + bonus(porous, 0.15)
        + bonus(topic == "defect", 0.20)
        + bonus(F.col("material").isNotNull(), 0.15))
    out = df.select(
        *messages.columns, "note", "event_type",
        F.when(gas & note.rlike("(?iu)аргон|argon"), "argon").alias("gas_type"),
        F.when(gas, F.col("_cylinder")).alias("gas_cylinder_id"),
        F.when(powder, F.col("_batch")).alias("powder_batch"),
        F.when(topic == "restart", F.col("_layer")).alias("layer"),
        F.when(topic == "service", part).alias("component"),
        action.alias("action"), value.alias("value"), unit.alias("unit"), "material",
        confidence.alias("confidence"))
    sure = F.round("confidence", 9) >= 0.75
    return out.select(
        "*",
        F.when(sure, "draft").otherwise("unverified").alias("verification_status"),
        (~sure).alias("needs_confirmation"),
        F.when(F.round("confidence", 9) < 0.55,
               F.lit("Message is ambiguous and should be confirmed or clarified.")).alias("parse_warning"))


def export_row(df: DataFrame, fields: list[str]) -> DataFrame:
    """Journal rows as JSON text for hand-over."""
    return df.select(F.to_json(F.struct(*fields)).alias("payload"))
