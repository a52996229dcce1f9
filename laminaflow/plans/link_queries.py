"""Joins: linking, as-of, overlays, wear, powder, prices, adjacency, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminaflow import model
from laminaflow.operators import insights, linking
from laminaflow.plans import adapters as a
from laminaflow.plans.catalog import big, num, query, ts

_P = f"{a.PAIRS}, p AS (SELECT r.record_id, s.session_id, r.user_id, r.anchor_ts, s.start_ts, epoch_us(s.start_ts) - epoch_us(r.anchor_ts) AS gap FROM r JOIN s ON r.user_id = s.user_id AND s.start_ts BETWEEN r.anchor_ts - INTERVAL 24 HOUR AND r.anchor_ts + INTERVAL 24 HOUR)"


@query(f"""WITH {_P}, c AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS cr, count(*) OVER (PARTITION BY session_id) AS cs FROM p)
SELECT record_id, session_id, user_id, 'time' AS method, {num('gap / 1e6')} AS delta_sec FROM c WHERE cr = 1 AND cs = 1""")
def interval_link(spark, d):
    return linking.link_by_time(a.records(spark, d), a.print_sessions(spark, d), 24.0, ["user_id"])


@query(f"""WITH {_P} SELECT record_id, session_id, user_id, {ts('start_ts')} AS start_ts, {ts("start_ts + INTERVAL 90 MINUTE")} AS end_ts, {num('90')} AS duration_min,
  {num('abs(gap) / 3.6e9')} AS hours_from_record_date FROM p""")
def link_candidates(spark, d):
    return linking.link_candidates(a.records(spark, d), a.print_sessions(spark, d), 24.0, ["user_id"])


@query(f"""WITH {a.PAIRS}, d AS (SELECT user_id, date_trunc('day', start_ts) AS day, count(*) AS n, min(session_id) AS session_id FROM s GROUP BY 1, 2)
SELECT record_id, session_id, 'hint' AS method FROM r JOIN d ON r.user_id = d.user_id AND date_trunc('day', r.anchor_ts) = d.day WHERE n = 1""")
def hint_link(spark, d):
    rec = a.records(spark, d).withColumn("hint_date", F.date_format("created_at", "yyyy-MM-dd"))
    return linking.link_by_hint(rec, a.print_sessions(spark, d), ["user_id"])


@query(f"""WITH {a.PAIRS}, d AS (SELECT user_id, date_trunc('day', start_ts) AS day, count(*) AS n, min(session_id) AS session_id FROM s GROUP BY 1, 2),
h AS (SELECT record_id, session_id FROM r JOIN d ON r.user_id = d.user_id AND date_trunc('day', anchor_ts) = d.day WHERE n = 1),
p AS (SELECT record_id, session_id, epoch_us(start_ts) - epoch_us(anchor_ts) AS gap FROM r JOIN s ON r.user_id = s.user_id AND start_ts BETWEEN anchor_ts - INTERVAL 24 HOUR AND anchor_ts + INTERVAL 24 HOUR
  WHERE record_id NOT IN (SELECT record_id FROM h) AND session_id NOT IN (SELECT session_id FROM h)),
c AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS cr, count(*) OVER (PARTITION BY session_id) AS cs FROM p)
SELECT record_id, session_id, 'hint' AS method, NULL AS delta_sec FROM h UNION ALL SELECT record_id, session_id, 'time', {num('gap / 1e6')} FROM c WHERE cr = 1 AND cs = 1""")
def auto_link(spark, d):
    rec = a.records(spark, d).withColumn("hint_date", F.date_format("created_at", "yyyy-MM-dd"))
    return linking.auto_link(rec, a.print_sessions(spark, d), 24.0, ["user_id"])


# one record of every user at a time, with the list of sessions that are taken
@query(f"""WITH RECURSIVE {a.PAIRS}, rec AS (SELECT user_id, record_id, date_trunc('day', anchor_ts) AS rd, row_number() OVER (PARTITION BY user_id ORDER BY record_id) AS n FROM r),
ses AS (SELECT user_id, session_id, date_trunc('day', start_ts) AS sd, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', start_ts), session_id) AS pos FROM s),
st AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS BIGINT) AS pos FROM (SELECT DISTINCT user_id FROM rec)
  UNION ALL SELECT user_id, n, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, record_id, p FROM (
    SELECT st.user_id, rec.n, any_value(st.used) AS used, rec.record_id, min(ses.pos) AS p FROM st JOIN rec ON rec.user_id = st.user_id AND rec.n = st.n + 1
    LEFT JOIN ses ON ses.user_id = st.user_id AND ses.sd BETWEEN rec.rd AND rec.rd + INTERVAL 45 DAY AND NOT list_contains(st.used, ses.pos) GROUP BY 1, 2, 4))
SELECT record_id, session_id, {num('epoch(sd) - epoch(rd)')} AS delta_sec FROM st JOIN ses USING (user_id, pos) JOIN rec USING (user_id, record_id)""")
def forward_asof_link(spark, d):
    rec = a.records(spark, d).select("record_id", "user_id", F.col("record_id").alias("record_no"), F.to_date("created_at").alias("record_day"))
    ses = a.print_sessions(spark, d).select("session_id", "user_id", F.to_date("start_ts").alias("session_day"))
    return linking.link_forward(rec, ses, 45, ["user_id"])


@query(f"""WITH {a.EV} SELECT event_id AS session_id, user_id, {ts('ts')} AS start_ts FROM ev WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id + 1 FROM ev WHERE event_type = 'purchase')""")
def anti_claimed(spark, d):
    claimed = a.records(spark, d).withColumn("session_id", F.col("record_id") + 1)
    return linking.unclaimed(a.print_sessions(spark, d).drop("end_ts"), claimed)


@query(f"""WITH {a.SE}, {a.OC} SELECT se.session_id, classification, result FROM se LEFT JOIN oc USING (session_id)""")
def label_join(spark, d):
    return a.sessions(spark, d).join(a.outcomes(spark, d), "session_id", "left").select("session_id", "classification", "result")


@query(f"""WITH {a.EV}, {a.OC}, u AS (SELECT user_id AS session_id, max(ts) AS m FROM ev GROUP BY 1 ORDER BY m DESC, session_id LIMIT 40)
SELECT outcome_id, session_id, result FROM oc WHERE session_id IN (SELECT session_id FROM u)""")
def semi_last_n(spark, d):
    last = a.events(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("start_ts"))
    return linking.in_sessions(a.outcomes(spark, d), linking.last_sessions(last, 40)).select("outcome_id", "session_id", "result")


_COMP = "CASE WHEN k < 25 THEN 'recoater_blade' WHEN k < 50 THEN 'hepa_filter' WHEN k < 75 THEN 'protective_glass' ELSE 'laser_fiber' END"
_CONS = "cons(component, label, max_hours, warn_pct) AS (VALUES " + ", ".join(
    f"('{k}', '{v[0]}', CAST({v[1]} AS DOUBLE), CAST({v[2]} AS DOUBLE))" for k, v in model.CONSUMABLES.items()) + ")"


@query(f"""WITH {a.EV}, se AS (SELECT ts AS start_ts, value AS duration_min, CASE WHEN event_type = 'click' THEN 'REAL_PRINT' ELSE 'SERVICE_SESSION' END AS classification FROM ev), {_CONS}, m AS (SELECT {_COMP} AS component, max(ts) AS t FROM ev WHERE event_type = 'error' GROUP BY 1),
u AS (SELECT c.component, any_value(c.label) AS label, any_value(m.t) AS t, any_value(max_hours) AS mh, any_value(warn_pct) AS wp, coalesce(sum(se.duration_min) FILTER (m.t IS NULL OR se.start_ts >= m.t), 0) / 60 AS h
  FROM cons c LEFT JOIN m USING (component) LEFT JOIN se ON se.classification IN ('REAL_PRINT', 'REAL_PRINT_WITH_RESUME') GROUP BY 1)
SELECT component, label, {ts('t')} AS last_service, {num('h')} AS used_hours, {num('mh')} AS max_hours, {num('least(100, h / mh * 100)')} AS pct, {num('greatest(0, mh - h)')} AS remaining_hours,
  CASE WHEN h / mh * 100 >= 100 THEN 'critical' WHEN h / mh * 100 >= wp THEN 'warning' ELSE 'ok' END AS grade FROM u""")
def consumable_wear(spark, d):
    k = F.col("k")
    part = F.when(k < 25, "recoater_blade").when(k < 50, "hepa_filter").when(k < 75, "protective_glass").otherwise("laser_fiber")
    ev = a.events(spark, d)
    work = ev.where("event_type = 'error'").select(part.alias("component"), F.col("ts").alias("timestamp"))
    prints = ev.select(F.col("ts").alias("start_ts"), F.col("value").alias("duration_min"), F.when(F.col("event_type") == "click", "REAL_PRINT").otherwise("SERVICE_SESSION").alias("classification"))
    return linking.accumulated_since_service(prints, work, model.consumable_dimension(spark), model.REAL_PRINT_CLASSES)


def _params(spark, d):
    """Every part asks for its material's parameters; each material has two default presets, of which the first counts."""
    base = a.table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"), F.lower("p_type").alias("material"), F.col("p_size").cast("double").alias("hatch_speed_mm_s"),
        F.lit(500.0).alias("contour_speed_mm_s"), F.lit(None).cast("double").alias("hatch_distance_mm"), F.lit(0.05).alias("layer_thickness_mm"),
        F.lit(2).alias("laser_count"))
    presets = a.table(spark, d, "part").groupBy(F.col("p_type").alias("material")).agg(
        F.when(F.avg("p_size") > 25.5, F.avg("p_retailprice")).alias("hatch_speed_mm_s"), F.lit(0.1).alias("hatch_distance_mm"), F.lit(1).alias("preset_id"))
    later = presets.select("material", F.lit(9.0).alias("hatch_speed_mm_s"), F.lit(0.9).alias("hatch_distance_mm"), F.lit(2).alias("preset_id"))
    return base, later.unionByName(presets).withColumn("is_default", F.lit(True))


_OV = """pr AS (SELECT lower(p_type) AS m, CASE WHEN avg(p_size) > 25.5 THEN avg(p_retailprice) END AS hs FROM part GROUP BY 1),
ov AS (SELECT p_partkey AS part_id, lower(p_type) AS material, coalesce(hs, p_size) AS hatch_speed_mm_s, 500.0 AS contour_speed_mm_s, 0.1 AS hatch_distance_mm FROM part JOIN pr ON lower(p_type) = pr.m)"""


@query(f"WITH {_OV} SELECT part_id, material, {num('hatch_speed_mm_s')} AS hatch_speed_mm_s, {num('hatch_distance_mm')} AS hatch_distance_mm, 'true' AS configured FROM ov")
def param_overlay(spark, d):
    base, presets = _params(spark, d)
    merged = linking.overlay_params(base, presets, ["hatch_speed_mm_s", "hatch_distance_mm"])
    return merged.select("part_id", "material", "hatch_speed_mm_s", "hatch_distance_mm", linking.params_ready().alias("configured"))


def _powder(spark, d):
    """Suppliers own batches; every part a supplier ships is a cycle, its line items are the history."""
    batches = a.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("batch_id"), F.col("s_name").alias("batch_code"), F.col("s_nationkey").cast("string").alias("material"),
        (F.abs("s_acctbal") * 100).alias("initial_kg"))
    key = [F.col("l_suppkey").alias("batch_id"), F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("cycle_id")]
    items = a.table(spark, d, "lineitem")
    history = items.select(*key, F.when(F.col("l_returnflag") == "R", "sieved").otherwise("consumed").alias("event"), F.col("l_quantity").alias("kg"))
    cycles = items.groupBy(*key).agg(F.count_if(F.col("l_returnflag") == "R").alias("reuse_count"),
                                     F.min("l_shipdate").cast("timestamp").alias("started_at"))
    return batches, cycles, history


@query(f"""WITH c AS (SELECT l_suppkey AS b, CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS cycle_id, sum(l_quantity) FILTER (l_returnflag <> 'R') AS kg,
  count(*) FILTER (l_returnflag = 'R') AS reuse, min(l_shipdate) AS st FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY st DESC, cycle_id DESC) AS rn FROM c),
g AS (SELECT b, sum(kg) AS kg, max(reuse) AS mr, max(reuse) FILTER (rn = 1) AS lr, max(cycle_id) FILTER (rn = 1) AS lc FROM r GROUP BY 1),
j AS (SELECT s_suppkey AS batch_id, s_name, CAST(s_nationkey AS VARCHAR) AS material, abs(s_acctbal) * 100 AS ini, coalesce(kg, 0) AS kg, coalesce(lr, 0) AS lr, lc, greatest(0, 100 - 8 * coalesce(mr, 0)) AS q FROM supplier LEFT JOIN g ON b = s_suppkey)
SELECT batch_id, material, s_name AS batch_code, {num('ini')} AS initial_kg, {num('kg')} AS consumed_kg, {num('ini - kg')} AS remaining_kg, {num('greatest(0, ini - kg)')} AS remaining_kg_floor,
  {num('CASE WHEN ini > 0 THEN greatest(0, (ini - kg) / ini * 100) ELSE 0 END')} AS remaining_pct, lr AS reuse_count, lc AS active_cycle, {num('q')} AS quality_pct,
  CASE WHEN q >= 70 THEN 'ok' WHEN q >= 40 THEN 'warning' ELSE 'critical' END AS quality_grade FROM j""")
def batch_history(spark, d):
    return linking.batch_report(*_powder(spark, d))


@query(f"""SELECT CAST(c_nationkey AS BIGINT) AS nation, {num("coalesce(arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P'), 7)")} AS powder_cost
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def last_powder_price(spark, d):
    rec = a.table(spark, d, "orders").join(a.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("powder_cost"))
    return linking.last_price(rec, F.lit(7.0), ["nation"])


_KIND = "CASE WHEN event_type = 'error' THEN 'anomaly' WHEN event_type = 'purchase' THEN 'operator_event' ELSE 'machine' END"


def _edges(spark, d):
    kind = F.when(F.col("event_type") == "error", "anomaly").when(F.col("event_type") == "purchase", "operator_event").otherwise("machine")
    items = a.events(spark, d).select("user_id", F.col("event_id").alias("id"), "ts", kind.alias("kind"), "event_type")
    return linking.time_adjacency(items, ["user_id"], ["id"], 3 * 3600)


_EDGES = f"""{a.EV}, it AS (SELECT *, {_KIND} AS kind FROM ev), n AS (SELECT user_id, event_id, ts, kind, event_type, lead(event_id) OVER w AS tg, lead(ts) OVER w AS tt, lead(kind) OVER w AS tk, lead(event_type) OVER w AS te
  FROM it WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ed AS (SELECT user_id, event_id AS source, kind AS source_kind, event_type AS source_type, tg AS target, tk AS target_kind, te AS target_type, CASE WHEN epoch_us(tt) - epoch_us(ts) <= 10800000000 THEN 'temporally_near' ELSE 'precedes' END AS relationship,
  (epoch_us(tt) - epoch_us(ts)) / 1e6 AS delta FROM n WHERE tg IS NOT NULL)"""


@query(f"WITH {_EDGES} SELECT * EXCLUDE (delta), {num('delta')} AS delta_sec FROM ed")
def time_adjacency(spark, d):
    return _edges(spark, d)


@query(f"""WITH {_EDGES} SELECT * EXCLUDE (delta), {num('delta')} AS delta_sec, 'Operator context precedes anomaly' AS title, 'candidate_insight' AS status, {num('least(0.3, 1) * 0.45 + 0.7 * 0.45 - 0.15')} AS confidence
FROM ed WHERE source_kind = 'operator_event' AND target_kind = 'anomaly'""")
def edge_hypotheses(spark, d):
    return insights.candidate_hypotheses(_edges(spark, d), F.lit(25), F.lit(0.7), 0.15)


def _journal(spark, d):
    """Events as journal rows of the machine ``user``; purchases above k = 80 stay unconfirmed."""
    kind, k = F.col("event_type"), F.col("k")
    return a.events(spark, d).select(
        F.col("user_id").alias("printer_id"), "event_id", F.col("ts").alias("timestamp"),
        F.when(kind == "error", F.when(k < 50, "filter_replaced").otherwise("optics_cleaned")).when(kind == "click", "gas_cylinder_replaced").otherwise("material_selected").alias("event_type"),
        F.when(kind == "view", F.concat(F.lit("M"), F.floor(k / 25).cast("string"))).alias("material"),
        F.when(kind == "signup", F.concat(F.lit("B"), F.floor(k / 10).cast("string"))).alias("powder_batch"),
        F.lit(None).cast("string").alias("gas_type"), F.when(kind == "click", F.concat(F.lit("C"), k.cast("string"))).alias("gas_cylinder_id"),
        F.when(kind == "signup", k.cast("string")).alias("value"), F.when(kind == "signup", "reuse_cycle").alias("unit"),
        F.when((kind == "purchase") | (k > 80), "unverified").otherwise("operator_confirmed").alias("verification_status"))


_JR = f"""{a.EV}, jr AS (SELECT user_id AS printer_id, event_id, ts, CASE WHEN event_type = 'view' THEN 'M' || CAST(k // 25 AS VARCHAR) END AS material,
  CASE WHEN event_type = 'signup' THEN 'B' || CAST(k // 10 AS VARCHAR) END AS powder_batch, CASE WHEN event_type = 'click' THEN 'C' || CAST(k AS VARCHAR) END AS gas_cylinder_id,
  CASE WHEN event_type = 'signup' THEN k END AS reuse, CASE WHEN event_type = 'error' AND k < 50 THEN 1 END AS flt, CASE WHEN event_type = 'error' AND k >= 50 THEN 1 END AS opt
  FROM ev WHERE event_type <> 'purchase' AND k <= 80)"""
_CH = _JR + """, lo AS (SELECT printer_id, event_id, ts, 'material' AS field, material AS value FROM jr WHERE material IS NOT NULL
UNION ALL SELECT printer_id, event_id, ts, 'powder_batch', powder_batch FROM jr WHERE powder_batch IS NOT NULL
UNION ALL SELECT printer_id, event_id, ts, 'gas_cylinder_id', gas_cylinder_id FROM jr WHERE gas_cylinder_id IS NOT NULL
UNION ALL SELECT printer_id, event_id, ts, 'powder_reuse_count', CAST(reuse AS VARCHAR) FROM jr WHERE reuse IS NOT NULL
UNION ALL SELECT printer_id, event_id, ts, 'filter_state', 'filter_replaced@' || strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM jr WHERE flt = 1
UNION ALL SELECT printer_id, event_id, ts, 'optics_cleaning_state', 'optics_cleaned@' || strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM jr WHERE opt = 1),
ch AS (SELECT *, lag(value) OVER (PARTITION BY printer_id, field ORDER BY ts, event_id) AS previous FROM lo)"""


@query(f"WITH {_CH} SELECT printer_id, event_id, field, value, previous, CAST(previous IS NOT NULL AND previous <> value AS VARCHAR) AS conflict FROM ch")
def context_changes(spark, d):
    return insights.context_changes(_journal(spark, d)).select("printer_id", "event_id", "field", "value", "previous", "conflict")


@query(f"WITH {_CH} SELECT printer_id, field, arg_max(value, event_id) AS value, {ts('max(ts)')} AS updated_at, count(*) FILTER (previous IS NOT NULL AND previous <> value) AS conflicts FROM ch GROUP BY 1, 2")
def context_state(spark, d):
    return insights.context_state(insights.context_changes(_journal(spark, d)))


@query(f"WITH {_CH} SELECT printer_id, field, value, {ts('ts')} AS valid_from, {ts('lead(ts) OVER (PARTITION BY printer_id, field ORDER BY ts, event_id)')} AS valid_to FROM ch")
def context_intervals(spark, d):
    return insights.context_intervals(insights.context_changes(_journal(spark, d)))


def _asof(v: str) -> str:
    return f"(SELECT arg_max({v}, event_id) FROM jr WHERE jr.printer_id = s.printer_id AND jr.ts <= s.start_ts AND {v} IS NOT NULL)"


@query(f"""WITH {_JR}, s AS (SELECT event_id AS session_id, user_id AS printer_id, ts AS start_ts FROM ev WHERE event_type = 'purchase')
SELECT session_id, printer_id, {_asof('material')} AS material, {_asof('powder_batch')} AS powder_batch, {_asof('gas_cylinder_id')} AS gas_cylinder_id, {big(_asof('reuse'))} AS powder_reuse_count,
  {num("(epoch_us(start_ts) - epoch_us((SELECT max(ts) FROM jr WHERE jr.printer_id = s.printer_id AND jr.ts <= s.start_ts AND flt = 1))) / 3.6e9")} AS filter_state_age_hours,
  {num("(epoch_us(start_ts) - epoch_us((SELECT max(ts) FROM jr WHERE jr.printer_id = s.printer_id AND jr.ts <= s.start_ts AND opt = 1))) / 3.6e9")} AS optics_cleaning_state_age_hours FROM s""")
def context_at_start(spark, d):
    starts = a.events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("session_id"), F.col("user_id").alias("printer_id"), F.col("ts").alias("start_ts"))
    out = insights.context_at_start(starts, _journal(spark, d))
    return out.select("session_id", "printer_id", "material", "powder_batch", "gas_cylinder_id", "powder_reuse_count", "filter_state_age_hours", "optics_cleaning_state_age_hours")
