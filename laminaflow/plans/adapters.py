"""The given tables seen as machine data. Every adapter is a projection: nothing is filtered away or sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# event type -> (machine event type, log family, subsystem, signal group, alarm low, alarm high)
EVENT_MEANING = {
    "signup": ("start", "main_event_log", "door", "oxygen", None, 150.0),
    "view": ("layer_pour", "time_log", "heating", "humidity", None, 120.0),
    "click": ("burn_event", "sensors_log", "automation", "pressure", 1.0, 200.0),
    "error": ("pause", "monitor100_log", "glove", "temperature", 2.0, None),
    "purchase": ("resume", "stateflow_log", "power", "temperature", None, 180.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meaning(i: int, col: Column | None = None) -> Column:
    col = F.col("event_type") if col is None else col
    out = None
    for kind, m in EVENT_MEANING.items():
        value = F.lit(m[i])
        out = F.when(col == kind, value) if out is None else out.when(col == kind, value)
    return out


def _sql_case(i: int, col: str = "event_type") -> str:
    lit = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)")
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {lit(m[i])}" for k, m in EVENT_MEANING.items()) + " END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (UTC), user_id, event_type, value, k."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


EV = ("ev AS (SELECT event_id, ts, user_id, event_type, value, "
      "CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)")


def signal_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, m[3], m[4], m[5]) for k, m in EVENT_MEANING.items()]
    return spark.createDataFrame(rows, "signal string, group string, alarm_low double, alarm_high double")


DIM = ("dim(signal, grp, alarm_low, alarm_high) AS (VALUES " + ", ".join(
    f"('{k}', '{m[3]}', {'CAST(NULL AS DOUBLE)' if m[4] is None else f'CAST({m[4]} AS DOUBLE)'}, "
    f"{'CAST(NULL AS DOUBLE)' if m[5] is None else f'CAST({m[5]} AS DOUBLE)'})" for k, m in EVENT_MEANING.items()) + ")")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session = user, signal = event type, position = event id (unique, increasing in time)."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("signal"), meaning(3).alias("group"),
        F.col("event_id").alias("idx"), "ts", "value")


RD = (EV + f", rd AS (SELECT user_id AS session_id, event_type AS signal, {_sql_case(3)} AS grp, "
      "event_id AS idx, ts, value FROM ev)")


def machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session = user, layer = k, machine event types; confidence grows with k."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.col("k").alias("layer"),
        meaning(0).alias("event_type"), F.lit(None).cast("string").alias("phase"), meaning(1).alias("family"),
        meaning(2).alias("subsystem"), (0.5 + F.col("k") / 250).alias("confidence"),
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("raw_excerpt"), F.sha2(F.concat_ws(" ", "event_type", F.col("k").cast("string")), 256).alias("line_sha"), "value")


ME = (EV + f", me AS (SELECT user_id AS session_id, event_id, ts, k AS layer, {_sql_case(0)} AS event_type, "
      f"{_sql_case(1)} AS family, {_sql_case(2)} AS subsystem, 0.5 + k / CAST(250 AS DOUBLE) AS confidence, value FROM ev)")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a state change of its subsystem."""
    return machine_events(spark, sf_dir).select("session_id", F.col("event_id").alias("id"), F.col("ts").alias("ts_start"),
                                                "subsystem", "family")


def day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel = event type of a user, session = calendar day: mean value per channel and day."""
    ev = events(spark, sf_dir)
    return ev.groupBy(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("signal"),
        F.date_format("ts", "yyyyMMdd").alias("session_id"), F.date_trunc("day", F.col("ts")).alias("start_ts"),
        meaning(3).alias("group")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


DS = (EV + f", ds AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS signal, strftime(ts, '%Y%m%d') AS session_id, "
      f"date_trunc('day', ts) AS start_ts, {_sql_case(3)} AS grp, avg(value) AS mean, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4)")


def user_day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel = event type, session = (user, day)."""
    ev = events(spark, sf_dir)
    sid = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return ev.groupBy(F.col("event_type").alias("signal"), sid.alias("session_id"), meaning(3).alias("group")).agg(
        F.min("ts").alias("start_ts"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


UD = (EV + f", ud AS (SELECT event_type AS signal, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, "
      f"{_sql_case(3)} AS grp, min(ts) AS start_ts, avg(value) AS mean, count(*) AS n FROM ev GROUP BY 1, 2, 3)")


def operator_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operator journal rows: consumption, replacements, service; value is text, as in the journal."""
    kind = F.col("event_type")
    ot = (F.when(kind == "purchase", "gas_consumption_recorded").when(kind == "view", "powder_consumption_recorded")
          .when(kind == "signup", "powder_reused").when(kind == "click", "gas_cylinder_replaced").otherwise("filter_replaced"))
    unit = F.when(kind == "purchase", F.when(F.col("k") < 50, "bar").otherwise("bar_remaining")).when(kind == "view", "kg")
    return events(spark, sf_dir).select(
        "event_id", F.col("ts").alias("timestamp"), ot.alias("event_type"),
        F.when(F.col("k") >= 95, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        unit.alias("unit"), F.col("user_id").alias("session_id"),
        F.when(kind.isin("purchase", "click"), F.concat(F.lit("C"), F.col("k").cast("string"))).alias("gas_cylinder_id"),
        F.when(kind.isin("view", "signup"), F.concat(F.lit("B"), F.col("k").cast("string"))).alias("powder_batch"))


OE = (EV + """, oe AS (SELECT event_id, ts AS timestamp,
  CASE event_type WHEN 'purchase' THEN 'gas_consumption_recorded' WHEN 'view' THEN 'powder_consumption_recorded'
    WHEN 'signup' THEN 'powder_reused' WHEN 'click' THEN 'gas_cylinder_replaced' ELSE 'filter_replaced' END AS event_type,
  CASE WHEN k >= 95 THEN NULL ELSE value END AS value,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN 'bar' ELSE 'bar_remaining' END WHEN event_type = 'view' THEN 'kg' END AS unit,
  user_id AS session_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'C' || CAST(k AS VARCHAR) END AS gas_cylinder_id,
  CASE WHEN event_type IN ('view', 'signup') THEN 'B' || CAST(k AS VARCHAR) END AS powder_batch FROM ev)""")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user: span, minutes, real print when it has more burn events than pauses."""
    ev = events(spark, sf_dir)
    burns, stops = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "error")
    agg = ev.groupBy(F.col("user_id").alias("session_id")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("total_lines"),
        F.sum("value").alias("duration_min"), burns.alias("telemetry_points"),
        F.count_if(F.col("event_type") == "purchase").alias("restart_count"), stops.alias("pause_count"),
        F.max("k").alias("max_k"))
    return agg.withColumn("classification", F.when(F.col("telemetry_points") > F.col("pause_count"), "REAL_PRINT")
                          .when(F.col("telemetry_points") == F.col("pause_count"), "REAL_PRINT_WITH_RESUME").otherwise("SERVICE_SESSION"))


SE = (EV + """, se0 AS (SELECT user_id AS session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS total_lines,
  sum(value) AS duration_min, count(*) FILTER (event_type = 'click') AS telemetry_points,
  count(*) FILTER (event_type = 'purchase') AS restart_count, count(*) FILTER (event_type = 'error') AS pause_count,
  max(k) AS max_k FROM ev GROUP BY 1),
se AS (SELECT *, CASE WHEN telemetry_points > pause_count THEN 'REAL_PRINT' WHEN telemetry_points = pause_count
  THEN 'REAL_PRINT_WITH_RESUME' ELSE 'SERVICE_SESSION' END AS classification FROM se0)""")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as quality outcomes of the session with the document's id."""
    r = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("toxic") == 1, "rejected").otherwise("warning")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("outcome_id"), F.col("doc_id").alias("session_id"), r.alias("result"),
        F.when(F.col("toxic") == 1, "porosity").when(F.col("quality") == 0, F.concat(F.lit("surface_"), "lang")).alias("defect_type"), "source")


OC = """oc AS (SELECT l.doc_id AS outcome_id, l.doc_id AS session_id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'rejected' ELSE 'warning' END AS result,
  CASE WHEN toxic = 1 THEN 'porosity' WHEN quality = 0 THEN 'surface_' || d.lang END AS defect_type, d.source
  FROM labels l JOIN documents d USING (doc_id))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as print records of their user; half of them know their print date."""
    ev = events(spark, sf_dir).where("event_type = 'purchase'")
    return ev.select(F.col("event_id").alias("record_id"), "user_id",
                     F.when(F.col("k") < 50, F.col("ts")).alias("printed_at"), F.col("ts").alias("created_at"),
                     F.lit(None).cast("long").alias("session_id"))


def print_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as log sessions of their user."""
    ev = events(spark, sf_dir).where("event_type = 'error'")
    return ev.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("start_ts"),
                     (F.col("ts") + F.expr("interval 90 minutes")).alias("end_ts"))


PAIRS = (EV + """, r AS (SELECT event_id AS record_id, user_id, ts AS anchor_ts FROM ev WHERE event_type = 'purchase'),
s AS (SELECT event_id AS session_id, user_id, ts AS start_ts FROM ev WHERE event_type = 'error')""")
