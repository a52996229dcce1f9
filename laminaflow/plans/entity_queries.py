"""Structured queries, fixed summaries, sets, tolerances, calibration, costs, risk, write-side merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laminaflow.operators import calibration, health, insights, linking, quality, risk, summaries
from laminaflow.operators.query import QuerySpec, list_entity, page, page_info, run_query, search_records, telemetry_sessions
from laminaflow.plans import adapters as a
from laminaflow.plans.catalog import big, num, query, ts
from laminaflow.plans.link_queries import _OV, _params
from laminaflow.plans.session_queries import DRIFT_SQL, READY_SQL, SCORE_SQL, SPIKES_SQL, _issues, _layer_times
from laminaflow.session import shared_dir
from laminaflow.sources import files as file_source
from laminaflow.sources import sinks, snapshots, tables

AS_OF = "2024-01-31 00:00:00"


def _entities(spark, d):
    return {"sessions": a.sessions(spark, d), "operator_events": a.operator_events(spark, d), "quality_outcomes": a.outcomes(spark, d),
            "import_jobs": a.table(spark, d, "pages").select("page_id", "url")}


# name -> spec and SQL of the structured query layer
_SPECS = {
    "query_count": (
        QuerySpec("operator_events", "count", filters=[
            {"field": "event_type", "operator": "eq", "value": "gas_consumption_recorded"}, {"field": "session_id", "operator": "lt", "value": 75}]),
        f"WITH {a.OE} SELECT count(*) AS result FROM oe WHERE event_type = 'gas_consumption_recorded' AND session_id < 75"),
    "query_group": (
        QuerySpec("operator_events", "group_by", group_by="gas_cylinder_id", limit=12, filters=[{"field": "unit", "operator": "contains", "value": "BAR"}]),
        f"WITH {a.OE} SELECT gas_cylinder_id AS value, count(*) AS count FROM oe WHERE unit ILIKE '%bar%' AND gas_cylinder_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"),
    "query_list": (
        QuerySpec("sessions", "list", order_by="start_ts", order_dir="desc", limit=20, offset=5, select=["session_id", "classification", "start_ts"]),
        f"WITH {a.SE} SELECT session_id, classification, {ts('start_ts')} AS start_ts FROM (SELECT * FROM se ORDER BY start_ts DESC, session_id LIMIT 20 OFFSET 5)"),
    "query_contains": (
        QuerySpec("import_jobs", "count", filters=[{"field": "url", "operator": "contains", "value": "EXAMPLE.org"}]),
        "SELECT count(*) AS result FROM pages WHERE url ILIKE '%example.org%'"),
    "query_between": (
        QuerySpec("sessions", "list", filters=[{"field": "pause_count", "operator": "between", "value": [10, 14]}, {"field": "classification", "operator": "in", "value": ["REAL_PRINT", "SERVICE_SESSION"]}],
                  select=["session_id", "pause_count"]),
        f"WITH {a.SE} SELECT session_id, pause_count FROM se WHERE pause_count BETWEEN 10 AND 14 AND classification IN ('REAL_PRINT', 'SERVICE_SESSION')"),
    "query_last_days": (
        QuerySpec("operator_events", "count", filters=[{"field": "days", "operator": "in_last_n", "value": 7}]),
        f"WITH {a.OE} SELECT count(*) AS result FROM oe WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"),
    "query_sum": (
        QuerySpec("operator_events", "sum", field="value", filters=[{"field": "unit", "operator": "eq", "value": "kg"}]),
        f"WITH {a.OE} SELECT {num('sum(value)')} AS result FROM oe WHERE unit = 'kg'"),
    "query_avg": (QuerySpec("sessions", "avg", field="duration_min"), f"WITH {a.SE} SELECT {num('avg(duration_min)')} AS result FROM se"),
    "query_max": (QuerySpec("sessions", "max", field="restart_count", filters=[{"field": "total_lines", "operator": "gte", "value": 60}]),
                  f"WITH {a.SE} SELECT max(restart_count) AS result FROM se WHERE total_lines >= 60"),
    "query_min": (QuerySpec("sessions", "min", field="total_lines", filters=[{"field": "duration_min", "operator": "gt", "value": 1000}, {"field": "pause_count", "operator": "lte", "value": 30}]),
                  f"WITH {a.SE} SELECT min(total_lines) AS result FROM se WHERE duration_min > 1000 AND pause_count <= 30"),
}


def _spec_query(spec):
    return lambda spark, d: run_query(spec, _entities(spark, d), F.lit(AS_OF).cast("timestamp"))


for _name, (_spec, _sql) in _SPECS.items():
    query(_sql, _name)(_spec_query(_spec))


@query(f"WITH {a.EV} SELECT 'm' || CAST(k AS VARCHAR) AS value, count(*) AS count FROM ev GROUP BY 1")
def query_json_path(spark, d):
    ctx = F.to_json(F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("m"), F.col("k").cast("string")).alias("material")).alias("features")).alias("group")).alias("runtime_payload")))
    return run_query(QuerySpec("sessions", "group_by", group_by="material"), {"sessions": a.events(spark, d).select("event_id", ctx.alias("context"))})


@query(f"""WITH r AS (SELECT o_orderkey AS record_id, o_orderpriority AS name, o_orderstatus AS material, o_orderdate AS d FROM orders WHERE o_orderpriority ILIKE '%HIGH%' AND o_orderstatus = 'F'
  AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31')
SELECT record_id, name, {ts('d')} AS effective_date FROM (SELECT * FROM r ORDER BY d DESC, record_id LIMIT 50 OFFSET 10)""")
def archive_search(spark, d):
    found = _archive(spark, d)
    return page(found, [F.desc("effective_date"), F.col("record_id")], 10, 50).select("record_id", "name", "effective_date")


def _archive(spark, d):
    rec = a.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("material"),
        F.lit(None).cast("timestamp").alias("printed_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return search_records(rec, "high", "F", "1996-01-01", "1998-12-31")


@query("SELECT count(*) AS total, least(50, count(*) - 10) AS count FROM orders WHERE o_orderpriority ILIKE '%HIGH%' AND o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'")
def archive_count(spark, d):
    return page_info(_archive(spark, d), 10, 50)


@query(f"WITH {a.SE} SELECT session_id, telemetry_points FROM se WHERE classification = 'REAL_PRINT' AND telemetry_points > 0")
def telemetry_sessions_list(spark, d):
    return telemetry_sessions(a.sessions(spark, d).withColumn("payload_classification", F.lit(None).cast("string"))).select("session_id", "telemetry_points")


@query(f"WITH {a.OE} SELECT event_id, session_id, {ts('timestamp')} AS timestamp FROM (SELECT * FROM oe WHERE event_type = 'filter_replaced' ORDER BY timestamp DESC, event_id LIMIT 100 OFFSET 20)")
def maintenance_listing(spark, d):
    rows = summaries.maintenance_events(a.operator_events(spark, d))
    return list_entity(rows, None, [F.desc("timestamp"), F.col("event_id")], 20, 100).select("event_id", "session_id", "timestamp")


_OE = a.OE[len(a.EV) + 2:]  # without the shared base view
_LAST = "last AS (SELECT session_id FROM se ORDER BY start_ts DESC, session_id LIMIT 30)"


@query(f"""WITH {a.SE}, {_OE}, {_LAST},
g AS (SELECT * FROM oe WHERE event_type IN ('gas_cylinder_replaced', 'gas_consumption_recorded', 'gas_pressure_issue') AND session_id IN (SELECT session_id FROM last)),
t AS (SELECT coalesce(sum(value) FILTER (event_type = 'gas_consumption_recorded' AND unit = 'bar'), 0) AS v, count(*) FILTER (event_type = 'gas_cylinder_replaced') AS c, count(*) FILTER (event_type = 'gas_consumption_recorded') AS r,
  string_agg(DISTINCT gas_cylinder_id, ',' ORDER BY gas_cylinder_id) AS cyl FROM g)
SELECT {num('v')} AS total_consumed_bar, {num('v / 30')} AS avg_per_session_bar, c AS cylinder_changes, r AS consumption_records, cyl AS cylinders_used, CAST(30 AS BIGINT) AS sessions_analyzed FROM t""")
def gas_summary(spark, d):
    return summaries.gas_summary(a.sessions(spark, d), a.operator_events(spark, d), 30)


@query(f"""WITH {a.SE}, {_OE}, {_LAST},
g AS (SELECT * FROM oe WHERE event_type IN ('powder_consumption_recorded', 'powder_reused') AND session_id IN (SELECT session_id FROM last)),
t AS (SELECT coalesce(sum(value) FILTER (event_type = 'powder_consumption_recorded' AND unit = 'kg'), 0) AS v, count(*) FILTER (event_type = 'powder_reused') AS r,
  max(floor(coalesce(value, 0))) FILTER (event_type = 'powder_reused') AS m, string_agg(DISTINCT powder_batch, ',' ORDER BY powder_batch) AS b FROM g)
SELECT {num('v')} AS total_consumed_kg, {num('v / 30')} AS avg_per_session_kg, b AS batches_used, r AS reuse_events, {big('m')} AS max_reuse_cycle, CAST(30 AS BIGINT) AS sessions_analyzed FROM t""")
def powder_summary(spark, d):
    return summaries.powder_summary(a.sessions(spark, d), a.operator_events(spark, d), 30)


@query(f"""WITH {a.SE}, {a.OC}, {_LAST}, t AS (SELECT count(*) AS n, count(*) FILTER (result = 'accepted') AS ac, count(*) FILTER (result = 'rejected') AS rj, count(*) FILTER (result = 'warning') AS w
  FROM oc WHERE session_id IN (SELECT session_id FROM last))
SELECT n AS total_outcomes, ac AS accepted, rj AS rejected, w AS warnings, {num('ac / greatest(n, 1) * 100')} AS accepted_pct, {num('rj / greatest(n, 1) * 100')} AS rejected_pct, CAST(30 AS BIGINT) AS sessions_analyzed FROM t""")
def quality_summary(spark, d):
    return summaries.quality_summary(a.sessions(spark, d), a.outcomes(spark, d), 30)


@query(f"WITH {a.OC} SELECT defect_type, count(*) AS n FROM oc WHERE defect_type IS NOT NULL GROUP BY 1")
def defect_histogram(spark, d):
    return summaries.defect_histogram(a.outcomes(spark, d))


@query(f"WITH {a.OC} SELECT count(*) AS quality_outcome_count, count(*) FILTER (result = 'rejected') AS rejected_count, count(*) FILTER (result = 'warning') AS warning_count, {num('1')} AS coverage FROM oc")
def quality_context(spark, d):
    return quality.quality_context(a.outcomes(spark, d))[0]


@query(f"WITH {a.OC} SELECT coalesce(defect_type, 'none') AS defect_type, count(*) AS n FROM oc GROUP BY 1")
def quality_context_defects(spark, d):
    return quality.quality_context(a.outcomes(spark, d))[1]


_FEATS = ["duration_min", "pause_count", "restart_count"]


def _rules(spark, d):
    """Ranges learned from the real prints, in start order."""
    good = a.sessions(spark, d).where("classification = 'REAL_PRINT_WITH_RESUME'")
    return summaries.learn_tolerances(good, _FEATS, ["start_ts"])


_TR = a.SE + ", lg AS (SELECT session_id, start_ts, classification, unnest(['duration_min', 'pause_count', 'restart_count']) AS feature, unnest([duration_min, CAST(pause_count AS DOUBLE), CAST(restart_count AS DOUBLE)]) AS value FROM se), " \
    "tr AS (SELECT feature, arg_min(value, (start_ts, session_id)) AS v0, min(value) AS lo, max(value) AS hi, arg_max(session_id, (start_ts, session_id)) AS ref FROM lg WHERE classification = 'REAL_PRINT_WITH_RESUME' GROUP BY 1), " \
    "rl AS (SELECT feature, least(v0 - greatest(v0 * 0.05, 1), lo) AS mn, greatest(v0 + greatest(v0 * 0.05, 1), hi) AS mx, ref FROM tr)"


@query(f"WITH {_TR} SELECT feature AS feature_name, {num('mn')} AS min_value, {num('mx')} AS max_value, ref AS session_id_reference, 'true' AS is_active FROM rl")
def tolerance_learning(spark, d):
    return _rules(spark, d)


@query(f"""WITH {_TR} SELECT session_id, lg.feature, {num('value')} AS value, {num('mn')} AS min_value, {num('mx')} AS max_value,
  CASE WHEN value < mn THEN 'below_learned_tolerance' ELSE 'above_learned_tolerance' END AS reason FROM lg JOIN rl USING (feature) WHERE value < mn OR value > mx""")
def tolerance_violations(spark, d):
    s = a.sessions(spark, d).select("session_id", *[F.col(c).cast("double").alias(c) for c in _FEATS])
    return summaries.tolerance_violations(s, _rules(spark, d), _FEATS)


@query(f"""WITH {_TR}, {_LAST}, v AS (SELECT session_id, count(*) AS n FROM lg JOIN rl USING (feature) WHERE value < mn OR value > mx GROUP BY 1)
SELECT session_id, classification, coalesce(n, 0) AS violations, CAST(coalesce(n, 0) = 0 AS VARCHAR) AS is_within_norm FROM se LEFT JOIN v USING (session_id) WHERE session_id IN (SELECT session_id FROM last)""")
def session_summary(spark, d):
    s = a.sessions(spark, d).select("session_id", "start_ts", "classification", *[F.col(c).cast("double").alias(c) for c in _FEATS])
    return summaries.session_summary(s, _rules(spark, d), _FEATS, 30).select("session_id", "classification", "violations", "is_within_norm")


_PT = a.SE + ", lg AS (SELECT session_id, unnest(['pause_count', 'restart_count']) AS name, unnest([pause_count, restart_count]) AS value FROM se), " \
    "pt AS (SELECT name || ':' || value AS pattern, name, value, count(*) AS count FROM lg WHERE value > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3)"


@query(f"WITH {_PT} SELECT * FROM pt")
def pattern_mining(spark, d):
    return summaries.repeated_patterns(a.sessions(spark, d), _FEATS)


@query(f"WITH {_PT} SELECT pattern, session_id FROM lg JOIN pt USING (name, value)")
def pattern_support(spark, d):
    s = a.sessions(spark, d)
    return summaries.pattern_support(s, summaries.repeated_patterns(s, _FEATS), _FEATS)


@query(f"""WITH {_PT}, n AS (SELECT count(*) AS n FROM se) SELECT pattern, count, n AS sample_size, 'Recurring pattern: ' || pattern AS title,
  CASE WHEN n < 3 THEN 'observation' WHEN n < 10 THEN 'weak_hypothesis' ELSE 'candidate_insight' END AS status,
  {num('CASE WHEN n < 3 THEN 0.25 WHEN n < 10 THEN least(greatest(0, least(count / n * 0.45 + 0.45 * 0.45 - 0.15, 0.95)), 0.55) ELSE greatest(0, least(count / n * 0.45 + 0.7 * 0.45 - 0.15, 0.95)) END')} AS confidence FROM pt, n""")
def hypothesis_score(spark, d):
    s = a.sessions(spark, d)
    return insights.pattern_hypotheses(summaries.repeated_patterns(s, _FEATS), s)


@query(f"""WITH {_PT}, n AS (SELECT count(*) AS n FROM se), h AS (SELECT max(count / n * 0.45 + 0.7 * 0.45 - 0.15) AS c, count(*) AS k FROM pt, n)
SELECT 'completed' AS status, 'weak_signal_found' AS verdict, {num('c')} AS confidence, k AS insights FROM h""")
def reanalysis_verdict(spark, d):
    s = a.sessions(spark, d)
    drafts = insights.insight_drafts(insights.pattern_hypotheses(summaries.repeated_patterns(s, _FEATS), s))
    return insights.reanalysis_verdict(s, drafts)


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("events", "orders", "lineitem", "documents", "pages", "conversations", "labels")))
def entity_counts(spark, d):
    names = ("events", "orders", "lineitem", "documents", "pages", "conversations", "labels")
    return summaries.entity_counts({n: a.table(spark, d, n) for n in names})


@query(f"""WITH {a.SE}, {_OE}, s AS (SELECT count(*) AS total, count(*) FILTER (classification = 'REAL_PRINT') AS prints, floor(sum(duration_min) / 60) AS hours, sum(total_lines) AS lines FROM se),
e AS (SELECT sum(value) FILTER (event_type = 'gas_consumption_recorded') AS g, sum(value) FILTER (event_type = 'powder_consumption_recorded') AS p FROM oe)
SELECT total, prints, {big('hours')} AS hours, {big('lines')} AS lines, {num('g')} AS gas_total, {num('p')} AS powder_total FROM s, e""")
def dashboard_totals(spark, d):
    return summaries.dashboard_totals(a.sessions(spark, d), a.operator_events(spark, d))


@query(f"WITH {a.OE} SELECT coalesce(unit, 'unknown') AS unit, count(*) AS n FROM oe GROUP BY 1")
def counts_by_category(spark, d):
    return summaries.counts_by(a.operator_events(spark, d), "unit", "unknown")


@query(f"WITH {a.SE} SELECT count(*) AS sessions_used, {num('avg(duration_min)')} AS avg_duration_min FROM se WHERE duration_min > 3000")
def historical_rate(spark, d):
    return summaries.historical_rate(a.sessions(spark, d), 3000.0)


@query(f"""WITH {a.SE} SELECT session_id, {ts('start_ts')} AS start_ts, telemetry_points FROM se p
WHERE classification = 'REAL_PRINT' AND telemetry_points > 0 ORDER BY telemetry_points DESC, p.start_ts DESC LIMIT 1""")
def richest_latest(spark, d):
    return summaries.richest_latest(a.sessions(spark, d))


@query(f"WITH {a.OE} SELECT {ts('timestamp')} AS timestamp, {num('value')} AS value, gas_cylinder_id, session_id FROM (SELECT * FROM oe WHERE event_type = 'gas_consumption_recorded' ORDER BY timestamp, event_id LIMIT 1000 OFFSET 50)")
def consumption_listing(spark, d):
    return summaries.consumption_listing(a.operator_events(spark, d), "gas_consumption_recorded", "gas_cylinder_id", 50, 1000)


@query(f"""WITH {a.OE}, u AS (SELECT session_id, max(gas_cylinder_id) AS gas_cylinder_id, max(powder_batch) FILTER (powder_batch < 'B5') AS powder_batch, max(unit) FILTER (unit = 'x') AS material FROM oe GROUP BY 1),
q AS (SELECT session_id, unnest([CASE WHEN material IS NULL THEN 'material' END, CASE WHEN powder_batch IS NULL THEN 'powder_batch' END, CASE WHEN gas_cylinder_id IS NULL THEN 'gas_cylinder_id' END]) AS field FROM u)
SELECT session_id, field, 'Please confirm ' || field || ' for session ' || session_id || '.' AS question FROM q WHERE field IS NOT NULL""")
def missing_context(spark, d):
    f = a.operator_events(spark, d).groupBy("session_id").agg(
        F.max("gas_cylinder_id").alias("gas_cylinder_id"), F.max(F.when(F.col("powder_batch") < "B5", F.col("powder_batch"))).alias("powder_batch"),
        F.max(F.when(F.col("unit") == "x", "y")).alias("material"))
    return summaries.missing_context(f)


@query(f"""WITH {a.SE}, r AS (SELECT session_id, restart_count AS n FROM se)
SELECT session_id, 'restart_chain_detected' AS rule_id, CAST(n >= 2 AS VARCHAR) AS matched, CASE WHEN n >= 2 THEN 'warning' ELSE 'info' END AS severity, {num('CASE WHEN n >= 2 THEN least(0.4 + n * 0.1, 0.9) ELSE 0 END')} AS confidence,
  CASE WHEN n >= 2 THEN n || ' restart attempts detected.' ELSE 'No restart chain.' END AS message FROM r
UNION ALL SELECT session_id, 'missing_production_context', 'true', 'warning', {num('1')}, 'Missing production context: powder_batch, gas_cylinder_id' FROM r""")
def rule_results(spark, d):
    facts = a.sessions(spark, d).select("session_id", F.col("restart_count").alias("restart_attempt_count"), F.lit("AlSi10Mg").alias("material"),
                                        F.lit(None).cast("string").alias("powder_batch"), F.lit("").alias("gas_cylinder_id"))
    return insights.default_rules().run(facts)


_UF = """c AS (SELECT 'SO' || l_linenumber AS col, l_returnflag AS family, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e FROM lineitem),
t AS (SELECT col, family, value, count(*) AS n, min((o, p, s, e)) AS f FROM c GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY col, family ORDER BY n DESC, f, value) AS rk FROM t)"""


@query(f"""WITH {_UF}, m AS (SELECT col, family, count(*) AS n FROM c GROUP BY 1, 2), d AS (SELECT col, family, string_agg(value || '=' || n, ',' ORDER BY rk) AS v FROM r WHERE rk <= 20 GROUP BY 1, 2),
x0 AS (SELECT *, row_number() OVER (PARTITION BY col, family ORDER BY o, p, s, e, value) AS rk FROM c), x AS (SELECT col, family, string_agg(value, ',' ORDER BY rk) AS v FROM x0 WHERE rk <= 5 GROUP BY 1, 2)
SELECT m.col AS "column", m.family, m.n AS occurrence_count, d.v AS value_distribution, x.v AS examples, 'oxygen_or_gas_candidate' AS candidate_semantic_class, {num('0.25')} AS confidence
FROM m JOIN d USING (col, family) JOIN x USING (col, family)""")
def unknown_fields(spark, d):
    cells = a.table(spark, d, "lineitem").select(
        F.concat(F.lit("SO"), F.col("l_linenumber").cast("string")).alias("column"), F.col("l_returnflag").alias("family"),
        F.col("l_quantity").cast("int").cast("string").alias("value"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    out = tables.unknown_field_report(cells, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.withColumn("value_distribution", F.transform("value_distribution", lambda v: F.concat(v["value"], F.lit("="), v["n"].cast("string"))))


# predictions: an order is a print record, its ship-to account the material, the line items its session
_AC = """s AS (SELECT l_orderkey AS sid, min(l_shipdate) AS t0, max(l_shipdate) AS t1 FROM lineitem GROUP BY 1),
ap AS (SELECT o_orderkey AS record_id, sid AS session_id, c_mktsegment AS material, t0, date_diff('second', t0, t1) / 3600 AS actual, o_totalprice / 10 AS predicted
  FROM orders JOIN s ON sid = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE t1 > t0 AND o_totalprice > 0)"""


def _accuracy(spark, d):
    li = a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(
        F.min("l_shipdate").cast("timestamp").alias("start_ts"), F.max("l_shipdate").cast("timestamp").alias("end_ts"))
    rec = a.table(spark, d, "orders").join(a.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("session_id"), F.col("c_mktsegment").alias("material"), (F.col("o_totalprice") / 10).alias("raw_print_hours"))
    return calibration.accuracy_pairs(rec, li)


@query(f"""WITH {_AC} SELECT record_id, session_id, material, {ts('t0')} AS start_ts, {num('actual')} AS actual_hours, {num('predicted')} AS predicted_hours, {num('actual / predicted')} AS ratio,
  {num('(predicted - actual) / actual * 100')} AS error_pct FROM ap""")
def accuracy_pairs(spark, d):
    return _accuracy(spark, d)


_CF = f"""{_AC}, rk AS (SELECT material, actual / predicted AS ratio, row_number() OVER (PARTITION BY material ORDER BY t0 DESC, record_id DESC) AS r, count(*) OVER (PARTITION BY material) AS n FROM ap),
cf AS (SELECT material, any_value(n) AS n_pairs, CASE WHEN any_value(n) >= 3 THEN median(ratio) END AS f FROM rk WHERE r <= 20 GROUP BY 1)"""


@query(f"WITH {_CF} SELECT material, n_pairs, {num('f')} AS suggested_factor FROM cf")
def calibration_factors(spark, d):
    return calibration.calibration_factors(_accuracy(spark, d))


@query(f"WITH {_AC}, rk AS (SELECT actual / predicted AS ratio, row_number() OVER (ORDER BY t0 DESC, record_id DESC) AS r, count(*) OVER () AS n FROM ap) SELECT any_value(n) AS n_pairs, {num('median(ratio)')} AS suggested_factor FROM rk WHERE r <= 20")
def calibration_overall(spark, d):
    return calibration.overall_factor(_accuracy(spark, d))


@query(f"""WITH {_CF}, j AS (SELECT material, n_pairs, round(f, 3) AS nf, 1.0 AS old FROM cf), st AS (SELECT *, CASE WHEN nf IS NULL THEN 'too_few_pairs' WHEN nf NOT BETWEEN 0.5 AND 2.0 THEN 'out_of_range' WHEN nf = old THEN 'unchanged' ELSE 'applied' END AS status FROM j)
SELECT material, n_pairs, {num('nf')} AS new_factor, {num('old')} AS old_factor, status, {num("CASE WHEN status = 'applied' THEN nf ELSE old END")} AS factor FROM st""")
def recalibrate(spark, d):
    f = calibration.calibration_factors(_accuracy(spark, d))
    current = a.table(spark, d, "customer").select(F.col("c_mktsegment").alias("material")).distinct().withColumn("factor", F.lit(1.0))
    return calibration.recalibrate(f, current)


# line items as sliced parts of an order's platform
_PTM = """sl AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS layers, l_extendedprice AS hatch, l_extendedprice / 10 AS contour, l_extendedprice / 5 AS jump, CAST(l_linenumber AS DOUBLE) AS nj,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE 1000.0 END AS hs, CASE WHEN l_linestatus = 'F' THEN 400.0 END AS cs, CASE WHEN l_returnflag = 'N' THEN 8000.0 END AS rc, 1 + l_tax AS cf, l_quantity * 1000 AS vol FROM lineitem),
tm AS (SELECT *, (hatch / hs + CASE WHEN cs > 0 THEN contour / cs ELSE 0 END + jump / 5000 + nj * 2.0 / 1000) * layers / 2 / 3600 AS scan, layers * coalesce(rc, 9500) / 1000 / 3600 AS recoat FROM sl)"""


def _slices(spark, d):
    li = a.table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("layer_count"), price.alias("hatch_len_mm"),
        (price / 10).alias("contour_len_mm"), (price / 5).alias("jump_len_mm"), F.col("l_linenumber").cast("double").alias("n_jumps"),
        F.when(F.col("l_returnflag") != "A", 1000.0).alias("hatch_speed_mm_s"), F.when(F.col("l_linestatus") == "F", 400.0).alias("contour_speed_mm_s"),
        F.lit(None).cast("double").alias("jump_speed_mm_s"), F.lit(2.0).alias("jump_delay_ms"), F.when(F.col("l_returnflag") == "N", 8000.0).alias("recoat_time_ms"),
        F.lit(2).alias("laser_count"), (1 + F.col("l_tax")).alias("correction_factor"), (F.col("l_quantity") * 1000).alias("volume_mm3"),
        (F.col("l_quantity") * 0.05).alias("height_mm"))


@query(f"""WITH {_PTM} SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {num('scan * cf')} AS scan_hours, {num('CASE WHEN hs IS NOT NULL THEN recoat * cf END')} AS recoat_hours, {num('(scan + recoat) * cf')} AS print_hours,
  {num('scan + recoat')} AS raw_print_hours, concat_ws(',', CASE WHEN cs IS NULL THEN 'contour_speed_missing' END, 'jump_speed_default', CASE WHEN rc IS NULL THEN 'recoat_time_default' END) AS time_warnings,
  CASE WHEN hs IS NULL THEN 'hatch_speed_missing' END AS unavailable_reason FROM tm""")
def print_time(spark, d):
    return calibration.print_time(_slices(spark, d)).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "scan_hours", "recoat_hours", "print_hours", "raw_print_hours", "time_warnings", "unavailable_reason")


@query(f"""WITH {_PTM}, g AS (SELECT l_orderkey, count(*) AS n_parts, sum(scan * cf) AS sh, arg_max(recoat * cf, (layers, -l_extended)) AS rh, max(layers) AS lc, sum(vol) AS vol FROM (SELECT tm.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY hatch, l_partkey, l_suppkey, l_linenumber) AS l_extended FROM tm WHERE hs IS NOT NULL) GROUP BY 1)
SELECT l_orderkey, n_parts, {num('sh')} AS scan_hours, {num('rh')} AS recoat_hours, {num('lc')} AS layer_count, {num('vol')} AS volume_mm3, {num('sh + rh')} AS print_hours FROM g""")
def platform_rollup(spark, d):
    from laminaflow.operators.ordered import Series
    parts = calibration.print_time(_slices(spark, d)).where("unavailable_reason is null")
    parts = Series(parts, ["l_orderkey"], ["hatch_len_mm", "l_partkey", "l_suppkey", "l_linenumber"]).with_row_number("part_no").frame
    return calibration.platform_rollup(parts, ["l_orderkey"]).drop("height_mm", "correction_factor", "warnings", "raw_print_hours")


@query(f"""WITH {_OV}, p AS (SELECT part_id, p_retailprice * 100 AS vol, CASE WHEN p_size > 10 THEN 7.8 END AS den, CASE WHEN p_brand <> 'Brand#1' THEN p_retailprice END AS pc, CASE WHEN p_size > 25 THEN 3.0 END AS gc, hatch_speed_mm_s AS h FROM part JOIN ov ON part_id = p_partkey),
c AS (SELECT *, vol / 1000 * den / 1000 AS kg, vol / 1000 * den / 1000 * pc AS pl, gc * 12 AS gl, h / 300 * 9000 AS fl FROM p)
SELECT part_id, {num('kg')} AS powder_kg, {num('pl')} AS powder_line, {num('gl')} AS gas_line, {num('fl')} AS filter_line, CAST(NULL AS DOUBLE) AS platform_line, {num('coalesce(pl, 0) + coalesce(gl, 0) + fl')} AS total_cost,
  concat_ws(',', CASE WHEN den IS NULL THEN 'density_missing' WHEN pl IS NULL THEN 'powder_price_missing' END, CASE WHEN gl IS NULL THEN 'gas_rate_missing' END, 'platform_rate_missing') AS cost_warnings FROM c""")
def cost_lines(spark, d):
    merged = linking.overlay_params(*_params(spark, d), ["hatch_speed_mm_s", "hatch_distance_mm"])
    p = a.table(spark, d, "part").join(merged.select("part_id", "hatch_speed_mm_s"), F.col("part_id") == F.col("p_partkey"))
    jobs = p.select("part_id", (F.col("p_retailprice") * 100).alias("volume_mm3"), F.when(F.col("p_size") > 10, 7.8).alias("density_g_cm3"),
                    F.when(F.col("p_brand") != "Brand#1", F.col("p_retailprice")).alias("powder_cost"), F.when(F.col("p_size") > 25, 3.0).alias("gas_cost_per_atm"),
                    F.lit(12.0).alias("gas_atm_per_print"), F.lit(9000.0).alias("filter_cost"), F.lit(300.0).alias("filter_lifetime_hours"),
                    F.lit(None).cast("double").alias("platform_cost"), F.col("hatch_speed_mm_s").alias("print_hours"))
    return calibration.cost(jobs).select("part_id", "powder_kg", "powder_line", "gas_line", "filter_line", "platform_line", "total_cost", "cost_warnings")


def _risk_features(spark, d):
    r = a.readings(spark, d)
    drift, _ = health.burn_drift(_layer_times(spark, d))
    ready = health.atmosphere_readiness(r).select("session_id", F.col("score").alias("readiness"))
    spikes = health.process_anomalies(r).groupBy("session_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    hl = ready.join(drift, "session_id", "left").join(spikes, "session_id", "left")
    stats = r.groupBy("session_id", "signal").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    stats = stats.withColumn("signal", F.when(F.col("signal") == "signup", "SO1").when(F.col("signal") == "click", "SO2").otherwise(F.col("signal")))
    ev = a.machine_events(spark, d)
    over = ev.groupBy("session_id").agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(6e7)).alias("duration_min"), F.count_distinct("layer").alias("layers"))
    return risk.feature_row(over, hl, stats, quality.quality_score(ev, _issues(spark, d)))


_RF = f"""{a.EV}, o2 AS (SELECT user_id AS session_id, avg(value) FILTER (event_type = 'signup') AS m1, stddev_pop(value) FILTER (event_type = 'signup') AS s1,
  avg(value) FILTER (event_type = 'click') AS m2, stddev_pop(value) FILTER (event_type = 'click') AS s2, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, count(DISTINCT k) AS layers FROM ev GROUP BY 1),
rf AS (SELECT session_id, y.score AS readiness, CAST(coalesce(p.c, 0) AS DOUBLE) AS anomaly_count, coalesce(b.slope, 0) AS burn_slope, q.score AS data_quality,
  coalesce(m1, m2) AS o2_mean, CASE WHEN m1 IS NOT NULL THEN s1 ELSE s2 END AS o2_std, us / 6e7 AS duration_min, CAST(layers AS DOUBLE) AS layers
  FROM o2 LEFT JOIN {READY_SQL} y USING (session_id) LEFT JOIN {DRIFT_SQL} b USING (session_id) LEFT JOIN {SPIKES_SQL} p USING (session_id) LEFT JOIN {SCORE_SQL} q USING (session_id))"""
_RF_COLS = "session_id, " + ", ".join(f"{num(c)} AS {c}" for c in ("readiness", "anomaly_count", "burn_slope", "data_quality", "o2_mean", "o2_std", "duration_min", "layers"))


@query(f"WITH {_RF} SELECT {_RF_COLS} FROM rf")
def risk_features(spark, d):
    return _risk_features(spark, d)


@query(f"""WITH {_RF}, w AS (SELECT *, CASE WHEN readiness IS NULL THEN 0 ELSE 0.35 END + CASE WHEN data_quality IS NULL THEN 0 ELSE 0.15 END + 0.5 AS w FROM rf),
c AS (SELECT *, coalesce(greatest(0, (100 - readiness) / 100) * 0.35, 0) / w AS c1, coalesce(greatest(0, (100 - data_quality) / 100) * 0.15, 0) / w AS c2, least(1, anomaly_count / 5) * 0.25 / w AS c3, greatest(0, least(1, burn_slope / 0.5)) * 0.25 / w AS c4 FROM w),
f AS (SELECT session_id, string_agg(name, ',' ORDER BY c DESC, i) AS top FROM (SELECT session_id, 1 AS i, c1 AS c, 'Низкая готовность атмосферы' AS name FROM c UNION ALL SELECT session_id, 2, c2, 'Низкое качество данных' FROM c
  UNION ALL SELECT session_id, 3, c3, 'Аномалии процесса' FROM c UNION ALL SELECT session_id, 4, c4, 'Рост времени прожига' FROM c) WHERE c > 0 GROUP BY 1)
SELECT {_RF_COLS}, {num('c1 + c2 + c3 + c4')} AS risk, CASE WHEN c1 + c2 + c3 + c4 >= 0.6 THEN 'high' WHEN c1 + c2 + c3 + c4 >= 0.3 THEN 'medium' ELSE 'low' END AS grade, 'heuristic' AS method, coalesce(top, '') AS top_factors FROM c LEFT JOIN f USING (session_id)""")
def heuristic_risk(spark, d):
    return risk.heuristic_risk(_risk_features(spark, d)).withColumn("top_factors", F.transform("top_factors", lambda f: f["factor"]))


@query(f"""WITH {a.SE}, f AS (SELECT session_id, CASE WHEN pause_count > 10 THEN 100 - least(100, pause_count * 3) END AS rd, 100 - least(100, restart_count * 2) AS dq, CAST(max_k AS DOUBLE) - 95 AS an, duration_min / 10000 AS bs FROM se),
x AS (SELECT *, CASE WHEN rd IS NOT NULL THEN 0.35 ELSE 0 END + 0.65 AS w, CASE WHEN rd IS NOT NULL THEN greatest(0, (100 - rd) / 100) * 0.35 ELSE 0 END AS c1, greatest(0, (100 - dq) / 100) * 0.15 AS c2, least(1, an / 5) * 0.25 AS c3, greatest(0, least(1, bs / 0.5)) * 0.25 AS c4 FROM f),
r AS (SELECT *, (c1 + c2 + c3 + c4) / w AS risk FROM x)
SELECT session_id, {num('risk')} AS risk, CASE WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS grade FROM r""")
def heuristic_risk_blend(spark, d):
    s = a.sessions(spark, d)
    f = s.select("session_id", F.when(F.col("pause_count") > 10, 100 - F.least(F.lit(100), F.col("pause_count") * 3)).cast("double").alias("readiness"),
                 (100 - F.least(F.lit(100), F.col("restart_count") * 2)).cast("double").alias("data_quality"),
                 (F.col("max_k").cast("double") - 95).alias("anomaly_count"), (F.col("duration_min") / 10000).alias("burn_slope"))
    return risk.heuristic_risk(f).select("session_id", "risk", "grade")


@query(f"WITH {a.OC}, l AS (SELECT session_id, arg_max(CASE WHEN result = 'rejected' THEN 1 WHEN result = 'accepted' THEN 0 END, outcome_id) FILTER (result <> 'warning') AS label FROM oc GROUP BY 1) SELECT session_id, {big('label')} AS label FROM l WHERE label IS NOT NULL")
def outcome_labels(spark, d):
    return risk.latest_labels(a.outcomes(spark, d).withColumn("timestamp", F.lit(None).cast("timestamp")))


def _day_features(spark, d):
    """Every user-day is a session to score; its label says whether an error above k = 60 happened."""
    ev = a.events(spark, d).withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return ev.groupBy("session_id").agg(
        of("signup").alias("readiness"), F.count_if(F.col("event_type") == "error").cast("double").alias("anomaly_count"),
        (F.max("k") - F.min("k")).cast("double").alias("burn_slope"), of("view").alias("data_quality"), of("click").alias("o2_mean"), of("purchase").alias("o2_std"),
        F.sum("value").alias("duration_min"), F.count_distinct("k").cast("double").alias("layers"),
        F.max(F.when((F.col("event_type") == "error") & (F.col("k") > 60), 1).otherwise(0)).alias("label"))


@query()
def risk_logreg(spark, d):
    rows = _day_features(spark, d)
    return risk.score(rows.drop("label"), risk.train(rows, allow_trees=False)).select("session_id", "risk", "grade", "method")


@query()
def risk_gbt(spark, d):
    rows = _day_features(spark, d)
    return risk.score(rows.drop("label"), risk.train(rows)).select("session_id", "risk", "grade", "method")


# write side -------------------------------------------------------------------------------------------------

@query(f"""WITH {a.EV}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_type = 'click' DESC, event_id DESC) AS r FROM ev WHERE event_type IN ('view', 'click'))
SELECT user_id, {big('k')} AS k, event_id, {ts('ts')} AS ts FROM v WHERE r = 1""")
def upsert_merge(spark, d):
    ev = a.events(spark, d).select("user_id", "k", "event_type", "event_id", "ts")
    return sinks.merge_latest(ev.where("event_type = 'view'").drop("event_type"), ev.where("event_type = 'click'").drop("event_type"),
                              ["user_id", "k"], F.col("ts"))


@query(f"""WITH {a.EV}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS r FROM ev)
SELECT user_id, {big('k')} AS k, event_id, event_type, {ts('ts')} AS ts, {num('value')} AS value, {big('user_id % 4')} AS part FROM v WHERE r = 1""")
def snapshot_upsert(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    ev = a.events(spark, d).select("user_id", "k", "event_id", "event_type", "ts", "value", (F.col("user_id") % 4).alias("part"))
    first = F.col("event_type").isin("view", "purchase")
    newest = lambda rows: rows.groupBy("user_id", "k", "part").agg(F.max_by(F.struct("event_id", "event_type", "ts", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "k", "part", "r.*")
    for name, rows in (("early", ev.where(first)), ("late", ev.where(~first)), ("early", ev.where(first).withColumn("ts", F.current_timestamp()))):  # the replay changes nothing
        snapshots.upsert(spark, path, newest(rows), ["user_id", "k"], F.struct("ts", "event_id"), name, "part")
    return snapshots.read(spark, path)


@query(f"""WITH {a.EV}, e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS sid FROM ev), o AS (SELECT sid AS session_id, min(ts) AS a, CAST(NULL AS TIMESTAMP) AS b, 'old' AS p FROM e WHERE event_type = 'view' GROUP BY 1), n AS (SELECT sid AS session_id, min(ts) AS a, max(ts) AS b, 'new' AS p FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT session_id, {ts('coalesce(o.a, n.a)')} AS start_ts, {ts('coalesce(o.b, n.b)')} AS end_ts, coalesce(n.p, o.p) AS payload FROM o FULL JOIN n USING (session_id)""")
def merge_sessions(spark, d):
    ev = a.events(spark, d).withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    old = ev.where("event_type = 'view'").groupBy("session_id").agg(
        F.min("ts").alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"), F.lit("old").alias("payload"))
    new = ev.where("event_type = 'click'").groupBy("session_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.lit("new").alias("payload"))
    return sinks.merge_sessions(old, new)


@query(f"""WITH {a.EV}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM ev)
SELECT event_id AS source_line, 'event_' || substr(sha256(CAST(user_id AS VARCHAR) || '|' || rn), 1, 16) AS event_id, {num('CASE WHEN k < 90 THEN value END')} AS value FROM i""")
def event_rows(spark, d):
    ev = a.events(spark, d).select(F.col("user_id").cast("string").alias("source_file_id"), F.col("event_id").alias("source_line"),
                                   F.when(F.col("k") < 90, F.col("value")).when(F.col("k") < 95, float("nan")).otherwise(float("inf")).alias("value"))
    return sinks.event_rows(ev, ["source_line"]).select("source_line", "event_id", "value")


@query("SELECT doc_id, 'file_' || substr(sha256(source || '|' || sha256(text)), 1, 16) AS source_file_id FROM documents")
def file_row_ids(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", F.col("source").alias("session_id"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.lit("x").alias("name"))
    return sinks.file_rows(docs).select("doc_id", "source_file_id")


@query(f"""WITH {a.ME}, i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY session_id) AS total FROM me)
SELECT session_id, position, total, {ts('ts')} AS ts, {big('layer')} AS layer, subsystem, CAST(NULL AS VARCHAR) AS phase, event_type, {num('confidence')} AS confidence FROM i WHERE position <= 20""")
def evidence_rows(spark, d):
    return sinks.evidence_rows(a.machine_events(spark, d), ["ts", "event_id"], 20)


@query(f"""WITH {a.EV}, s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM ev GROUP BY 1), o AS (SELECT user_id, min(ts) AS a, max(ts) AS b, max(k) AS f FROM ev WHERE event_type <> 'error' GROUP BY 1)
SELECT user_id AS session_id, CASE WHEN f < 99 THEN 'missing_features' ELSE 'stale_span' END AS reason FROM o JOIN s USING (user_id) WHERE f < 99 OR o.a <> s.a OR o.b <> s.b""")
def backfill_candidates(spark, d):
    ev = a.events(spark, d)
    spans = ev.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("span_start"), F.max("ts").alias("span_end"))
    stored = ev.where("event_type <> 'error'").groupBy(F.col("user_id").alias("session_id")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.when(F.max("k") >= 99, F.max("k")).alias("features"))
    return sinks.incomplete_sessions(stored, spans).select("session_id", "reason")


@query(f"WITH {a.EV} SELECT event_id, user_id FROM ev WHERE (user_id, date_trunc('day', ts)) NOT IN (SELECT user_id, date_trunc('day', ts) FROM ev WHERE event_type = 'error')")
def unseen_rows(spark, d):
    ev = a.events(spark, d).withColumn("day", F.to_date("ts"))
    return file_source.unseen(ev, ev.where("event_type = 'error'"), ["user_id", "day"]).select("event_id", "user_id")


# page addresses as file names of a drop folder
_FN = """n AS (SELECT page_id, CASE WHEN url LIKE '%/de/%' THEN 'p_' || page_id || '_stateFlow.log' WHEN url LIKE '%/fr/%' THEN 'p_' || page_id || '_burn.log' WHEN url LIKE '%/es/%' THEN 'table_' || page_id || '_temp.log'
  WHEN url LIKE 'https%' THEN 'p_20240' || (1 + page_id % 9) || '05.log' ELSE 'p_' || page_id || '.txt' END AS name, length(html) * 2000 AS size FROM pages)"""


@query(f"""WITH {_FN} SELECT page_id, name, CASE WHEN name LIKE '%\\_stateFlow.log' ESCAPE '\\' THEN 'stateflow_log' WHEN name LIKE '%\\_burn.log' ESCAPE '\\' THEN 'burn_log' WHEN name LIKE 'table%temp.log' THEN 'table_temp_log' WHEN name LIKE '%.log' THEN 'main_event_log' ELSE 'unsupported' END AS family,
  CASE WHEN name LIKE '%\\_stateFlow.log' ESCAPE '\\' OR name LIKE '%\\_burn.log' ESCAPE '\\' THEN 'primary' WHEN name LIKE 'table%temp.log' THEN 'secondary' WHEN name LIKE '%.log' THEN 'primary' ELSE 'unknown' END AS role,
  {num("CASE WHEN name LIKE '%stateFlow.log' OR name LIKE '%burn.log' OR name LIKE 'table%temp.log' THEN 0.95 WHEN name LIKE '%.log' THEN 0.55 ELSE 0 END")} AS classification_confidence,
  CASE WHEN name LIKE '%\\_burn.log' ESCAPE '\\' THEN 'redundant file type: matches skip pattern ''*_burn.log''' END AS skip_reason,
  CASE WHEN name LIKE 'p\\_20240%' ESCAPE '\\' THEN '2024-0' || substr(name, 8, 1) || '-05' END AS name_date FROM n""")
def file_classification(spark, d):
    url, pid = F.col("url"), F.col("page_id").cast("string")
    name = (F.when(url.like("%/de/%"), F.concat(F.lit("p_"), pid, F.lit("_stateFlow.log"))).when(url.like("%/fr/%"), F.concat(F.lit("p_"), pid, F.lit("_burn.log")))
            .when(url.like("%/es/%"), F.concat(F.lit("table_"), pid, F.lit("_temp.log")))
            .when(url.like("https%"), F.concat(F.lit("p_20240"), (1 + F.col("page_id") % 9).cast("string"), F.lit("05.log"))).otherwise(F.concat(F.lit("p_"), pid, F.lit(".txt"))))
    pages = a.table(spark, d, "pages").select("page_id", F.concat(F.lit("/drop/"), name).alias("path"), (F.length("html") * 2000).alias("size_bytes"))
    return file_source.with_names(pages, "/drop").select("page_id", "name", "family", "role", "classification_confidence", "skip_reason", F.col("name_date").cast("string").alias("name_date"))


@query(f"""WITH {a.ME}, f AS (SELECT session_id, family, count(*) AS n FROM me GROUP BY 1, 2), r AS (SELECT session_id, family, n, row_number() OVER (PARTITION BY session_id ORDER BY family) AS p FROM f)
SELECT session_id, CAST(0 AS BIGINT) AS section_no, 'session_summary' AS section, 1 AS position, '{{"events":' || count(*) || '}}' AS body FROM me GROUP BY 1
UNION ALL SELECT session_id, 2, 'file_inventory', p, '{{"family":"' || family || '","n":' || n || '}}' FROM r
UNION ALL SELECT DISTINCT session_id, 8, 'version_metadata', 1, '{{"analysis_version":"0.1.0"}}' FROM me""")
def report_rows(spark, d):
    ev = a.machine_events(spark, d)
    summary = ev.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))
    inventory = ev.groupBy("session_id", "family").agg(F.count(F.lit(1)).alias("n"))
    return sinks.report_rows({"session_summary": (summary, ["events"]), "file_inventory": (inventory, ["family"])}, {"analysis_version": "0.1.0"})


@query()
def markdown_rows(spark, d):
    from laminaflow.operators import features
    ev = a.machine_events(spark, d)
    classes = ev.groupBy("session_id").agg(F.lit("REAL_PRINT").alias("classification"), F.max("confidence").alias("confidence"))
    files = ev.groupBy("session_id", F.col("family").alias("relative_path")).agg(
        F.first("family").alias("family"), F.lit("primary").alias("role"), F.count(F.lit(1)).alias("size_bytes"), F.lit("ok").alias("quality_status"))
    return sinks.markdown_rows(classes, files, features.phase_segments(ev, None, ["event_id"]), features.layer_outliers(features.layer_features(ev)))


# sets ---------------------------------------------------------------------------------------------------------

@query(f"WITH {a.ME} SELECT session_id, event_id, 'event' AS kind FROM me UNION ALL SELECT session_id, event_id, 'transition' FROM me WHERE family <> 'monitor100_log'")
def union_stamps(spark, d):
    ev = a.machine_events(spark, d)
    return file_source.union_all([ev.select("session_id", "event_id", F.lit("event").alias("kind")),
                                  ev.where("family <> 'monitor100_log'").select("session_id", "event_id", F.lit("transition").alias("kind"))])


@query(f"WITH {a.EV} SELECT user_id, {big('k')} AS k FROM ev WHERE event_type = 'view' INTERSECT SELECT user_id, k FROM ev WHERE event_type = 'click'")
def layer_intersection(spark, d):
    ev = a.events(spark, d)
    return ev.where("event_type = 'view'").select("user_id", "k").intersect(ev.where("event_type = 'click'").select("user_id", "k"))


@query(f"WITH {a.EV} SELECT user_id, {big('k')} AS k FROM ev WHERE event_type = 'view' EXCEPT SELECT user_id, k FROM ev WHERE event_type = 'click'")
def layer_difference(spark, d):
    ev = a.events(spark, d)
    return ev.where("event_type = 'view'").select("user_id", "k").subtract(ev.where("event_type = 'click'").select("user_id", "k"))


@query(f"""WITH {a.SE}, m AS (SELECT session_id, session_id // 10 AS g FROM se WHERE session_id < 50) SELECT coalesce('g' || g, CAST(session_id AS VARCHAR)) AS session_id, {ts('min(start_ts)')} AS start_ts, {ts('max(end_ts)')} AS end_ts, count(*) AS file_count FROM se LEFT JOIN m USING (session_id) GROUP BY 1""")
def manual_merge(spark, d):
    from laminaflow.operators.sessions import manual_merge as merge
    s = a.sessions(spark, d).withColumn("session_id", F.col("session_id").cast("string")).withColumn("file_count", F.lit(1).cast("long")).withColumn("grouping_confidence", F.lit(0.5))
    merges = s.where("cast(session_id as int) < 50").select("session_id", F.concat(F.lit("g"), F.floor(F.col("session_id").cast("int") / 10).cast("string")).alias("merged_id"))
    return merge(s, merges).drop("grouping_confidence")


@query(f"WITH {a.EV} SELECT user_id AS session_id, {ts('max(ts)')} AS created_at FROM ev GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 1")
def newest_session(spark, d):
    s = a.events(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("created_at"))
    return summaries.newest_session(s)


@query(f"""WITH {a.ME}, g AS (SELECT session_id, floor(epoch_us(ts) / 3600000000) AS b, event_type, layer // 10 AS l, subsystem, count(*) AS c FROM me GROUP BY 1, 2, 3, 4, 5)
SELECT session_id, 'deduplicated_semantic_equivalent_events' AS code, event_type, c AS copies FROM g WHERE c > 1""")
def dedup_diagnostics(spark, d):
    from laminaflow.operators import features
    ev = a.machine_events(spark, d).withColumn("layer", F.floor(F.col("layer") / 10))
    return features.dedup_diagnostics(features.deduplicate(ev, ["ts", "event_id"], 3600))


@query()
def session_kpis(spark, d):
    from laminaflow.operators import features
    ev = a.machine_events(spark, d).withColumn("session_id", F.concat(F.lit("session_"), F.col("session_id").cast("string")))
    spans = ev.groupBy("session_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    files = ev.groupBy("session_id", "family").agg(F.count(F.lit(1)).alias("line_count"))
    tr = ev.select("session_id", F.col("ts").alias("ts_start"), "subsystem", "family")
    over = features.session_overview(spans, files, ev, tr).drop("subsystem_instability")
    classes = a.sessions(spark, d).select(F.concat(F.lit("session_"), F.col("session_id").cast("string")).alias("session_id"), "classification")
    scores = quality.quality_score(spans, quality.layer_gaps(ev).select("session_id", F.lit("layer_gaps").alias("kind"), F.col("missing").alias("count")))
    return page(summaries.session_kpis(over, classes, scores), [F.desc("start_ts"), F.col("session_id")], 0, 100)


@query(f"""WITH {_PT}, n AS (SELECT count(*) AS n FROM se) SELECT 'Recurring pattern: ' || pattern AS title, 'recurring_pattern' AS insight_type, n AS sample_size,
  {num('greatest(0, least(count / n * 0.45 + 0.7 * 0.45 - 0.15, 0.95))')} AS confidence, 'needs_review' AS status, 'Draft insight generated by bounded historical analysis; requires human review.' AS description FROM pt, n""")
def insight_drafts(spark, d):
    s = a.sessions(spark, d)
    return insights.insight_drafts(insights.pattern_hypotheses(summaries.repeated_patterns(s, _FEATS), s))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity * 0.05 + CAST(0.00000000037 AS DOUBLE), 6) + 0.0 AS consumed_kg FROM lineitem")
def layer_consumption(spark, d):
    from laminaflow.operators.features import consumption_by_layers
    return a.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", consumption_by_layers(F.col("l_quantity")).alias("consumed_kg"))
