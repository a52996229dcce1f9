"""Per-session features, health, data quality, classes, de-duplication over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminaflow.operators import features, health, quality, sessions
from laminaflow.plans import adapters as a
from laminaflow.plans.catalog import SQL, big, num, query, ts

_LF = f"""{a.ME}, l0 AS (SELECT session_id, layer, count(*) AS c, CASE WHEN count(*) >= 2 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 END AS dur,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM me GROUP BY 1, 2),
lf AS (SELECT *, dur - last_value(dur IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM l0)"""


@query(f"""WITH {_LF} SELECT session_id, {big('layer')} AS layer, c AS event_count, {num('dur')} AS layer_duration_sec,
  {num('delta')} AS delta_from_previous_layer_sec, types AS event_types FROM lf""")
def layer_features(spark, d):
    return features.layer_features(a.machine_events(spark, d))


@query(f"""WITH {_LF}, md AS (SELECT session_id, median(dur) AS med FROM lf WHERE dur IS NOT NULL GROUP BY 1),
dv AS (SELECT lf.*, med, abs(dur - med) AS dev FROM lf JOIN md USING (session_id) WHERE dur IS NOT NULL),
mm AS (SELECT session_id, median(dev) AS mad FROM dv GROUP BY 1),
z AS (SELECT dv.*, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (dur - med) / mad END AS z FROM dv JOIN mm USING (session_id))
SELECT session_id, {big('layer')} AS layer, {num('dur')} AS layer_duration_sec, {num('z')} AS robust_z, 'layer_duration_outlier' AS anomaly_type, 'warning' AS severity,
  {num('least(abs(z) / 7, 0.95)')} AS confidence FROM z WHERE abs(z) >= 3.5""")
def layer_outliers(spark, d):
    return features.layer_outliers(features.layer_features(a.machine_events(spark, d)))


@query(f"""WITH {a.ME}, e AS (SELECT session_id, count(*) FILTER (event_type = 'finish') AS fin, count(*) FILTER (event_type = 'pause') AS p,
  count(*) FILTER (event_type IN ('restart_attempt', 'resume')) AS r, count(*) FILTER (subsystem IN ('door', 'glove')) AS s, min(ts) AS t0, max(ts) AS t1 FROM me GROUP BY 1)
SELECT session_id, CASE WHEN fin > 0 THEN 'finished' ELSE 'unknown' END AS completion_status, p AS pause_count, r AS restart_attempt_count, s AS service_state_density,
  {num('(epoch_us(t1) - epoch_us(t0)) / 1e6')} AS duration_sec FROM e""")
def session_features(spark, d):
    return features.session_features(a.machine_events(spark, d), a.transitions(spark, d)).drop("subsystem_instability")


@query(f"""WITH {a.ME} SELECT session_id, subsystem, count(*) AS n FROM me GROUP BY 1, 2""")
def subsystem_instability(spark, d):
    f = features.session_features(a.machine_events(spark, d), a.transitions(spark, d))
    return f.select("session_id", F.explode("subsystem_instability").alias("subsystem", "n"))


@query(f"""WITH {a.ME} SELECT session_id, {ts('min(ts)')} AS span_start, {ts('max(ts)')} AS span_end FROM me WHERE family <> 'monitor100_log' GROUP BY 1""")
def print_span(spark, d):
    return features.print_span(a.machine_events(spark, d), a.transitions(spark, d))


@query(f"""WITH {a.ME}, sp AS (SELECT session_id, min(ts) AS s0, max(ts) AS s1 FROM me WHERE family <> 'monitor100_log' GROUP BY 1),
e AS (SELECT session_id, min(ts) AS a0, max(ts) AS a1, count(*) AS n, count(*) FILTER (event_type LIKE '%burn%') AS b, count(DISTINCT layer) AS l,
  count(*) FILTER (event_type = 'pause') AS p, count(*) FILTER (event_type = 'resume') AS r, count(*) FILTER (subsystem IN ('door', 'glove')) AS sv, count(DISTINCT family) AS f FROM me GROUP BY 1),
j AS (SELECT *, CASE WHEN s1 > s0 THEN (epoch_us(s1) - epoch_us(s0)) / 1e6 WHEN a1 > a0 THEN (epoch_us(a1) - epoch_us(a0)) / 1e6 ELSE 0 END AS dur FROM e LEFT JOIN sp USING (session_id))
SELECT session_id, {ts('coalesce(s0, a0)')} AS start_ts, {ts('coalesce(s1, a1)')} AS end_ts, strftime(coalesce(s0, a0), '%H:%M') AS first_time,
  strftime(coalesce(s1, a1), '%H:%M') AS last_time, {num('dur')} AS duration_sec, {num('dur / 60')} AS duration_min, 'unknown' AS completion_status, 'unknown' AS material,
  n AS total_events, b AS burn_events, l AS layers, f AS file_count, n AS total_lines, p AS pause_count, r AS restart_attempt_count, sv AS service_state_density FROM j""")
def session_overview(spark, d):
    ev = a.machine_events(spark, d)
    spans = ev.groupBy("session_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    files = ev.groupBy("session_id", "family").agg(F.count(F.lit(1)).alias("line_count"))
    return features.session_overview(spans, files, ev, a.transitions(spark, d)).drop("subsystem_instability")


def _layer_times(spark, d):
    return a.events(spark, d).groupBy(F.col("user_id").alias("session_id"), F.col("k").alias("layer")).agg(F.sum("value").alias("duration_sec"))


_BD = f"""{a.EV}, lt AS (SELECT user_id AS session_id, k AS layer, sum(value) AS dur FROM ev GROUP BY 1, 2),
g AS (SELECT session_id, count(*) AS n, avg(dur) AS m, coalesce(regr_slope(dur, CAST(layer AS DOUBLE)), 0) AS s, stddev_pop(dur) AS sd FROM lt WHERE dur > 0 GROUP BY 1)"""


@query(f"""WITH {_BD} SELECT session_id, n AS n_layers, {num('CASE WHEN n >= 3 THEN m END')} AS mean_sec, {num('CASE WHEN n >= 3 THEN s END')} AS slope_sec_per_layer,
  CASE WHEN n < 3 THEN 'insufficient_data' WHEN s / m > 0.01 THEN 'rising' WHEN s / m < -0.01 THEN 'falling' ELSE 'stable' END AS trend FROM g""")
def burn_drift(spark, d):
    return health.burn_drift(_layer_times(spark, d))[0]


@query(f"""WITH {_BD}, z AS (SELECT lt.session_id, layer, dur, CASE WHEN sd = 0 THEN 0 ELSE (dur - m) / sd END AS z FROM lt JOIN g ON g.session_id = lt.session_id AND n >= 3 WHERE dur > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY layer) AS rn FROM z WHERE abs(z) >= 3)
SELECT session_id, rn AS position, {big('layer')} AS layer, {num('dur')} AS duration_sec, {num('z')} AS z_score FROM r""")
def burn_outlier_layers(spark, d):
    return health.burn_drift(_layer_times(spark, d))[1]


_RDY = f"""{a.RD}, sg AS (SELECT session_id, grp, signal, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM rd WHERE grp IN ('oxygen', 'pressure', 'humidity') GROUP BY 1, 2, 3 HAVING count(*) >= 5),
gf AS (SELECT session_id, grp, greatest(0, 1 - avg(CASE WHEN m = 0 THEN 0 ELSE s / abs(m) END) / 0.5) AS f FROM sg GROUP BY 1, 2),
sc AS (SELECT session_id, sum(f * w) / sum(w) * 100 AS score, max(f) FILTER (grp = 'oxygen') AS o, max(f) FILTER (grp = 'pressure') AS p, max(f) FILTER (grp = 'humidity') AS h
  FROM (SELECT *, CASE grp WHEN 'oxygen' THEN 0.5 WHEN 'pressure' THEN 0.3 ELSE 0.2 END AS w FROM gf) GROUP BY 1)"""


@query(f"""WITH {_RDY} SELECT session_id, {num('score')} AS score, {num('o')} AS oxygen_factor, {num('p')} AS pressure_factor, {num('h')} AS humidity_factor,
  CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade
FROM (SELECT DISTINCT session_id FROM rd) LEFT JOIN sc USING (session_id)""")
def readiness(spark, d):
    return health.atmosphere_readiness(a.readings(spark, d))


_RDY_SHIFT = _RDY.replace("avg(value) AS m", "avg(value) + 200 AS m")


@query(f"""WITH {_RDY_SHIFT} SELECT session_id, {num('score')} AS score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade
FROM (SELECT DISTINCT session_id FROM rd) LEFT JOIN sc USING (session_id)""")
def readiness_offset(spark, d):
    # a level of 200 on top keeps the coefficients of variation below the cut-off, so all grades occur
    return health.atmosphere_readiness(a.readings(spark, d).withColumn("value", F.col("value") + 200)).select("session_id", "score", "grade")


@query(f"""WITH {a.RD}, md AS (SELECT session_id, signal, median(value) AS med FROM rd GROUP BY 1, 2),
dv AS (SELECT rd.*, med, abs(value - med) AS dev FROM rd JOIN md USING (session_id, signal) WHERE grp IN ('oxygen', 'humidity', 'temperature')),
mm AS (SELECT session_id, signal, median(dev) AS mad, count(*) AS n FROM dv GROUP BY 1, 2),
pk AS (SELECT dv.*, mad, n, row_number() OVER (PARTITION BY dv.session_id, dv.signal ORDER BY dev DESC, idx) AS rf, row_number() OVER (PARTITION BY dv.session_id, dv.signal ORDER BY dev DESC, idx DESC) AS rl
  FROM dv JOIN mm USING (session_id, signal)),
g AS (SELECT session_id, signal, any_value(grp) AS grp, any_value(n) AS n, any_value(med) AS med, any_value(mad) AS mad, max(value) AS mx, max(value) FILTER (rf = 1) AS pv, stddev_pop(value) FILTER (rl <> 1) AS rest FROM pk GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN mad > 0 THEN 0.6745 * (pv - med) / mad WHEN rest > 0 THEN (pv - med) / rest WHEN pv <> med THEN 99 END AS z FROM g WHERE n >= 5)
SELECT session_id, signal, CASE grp WHEN 'oxygen' THEN 'кислород' WHEN 'humidity' THEN 'влажность' ELSE 'температура' END AS semantic, 'spike' AS kind,
  CASE grp WHEN 'oxygen' THEN 'high' ELSE 'medium' END AS severity, {num('pv')} AS value, {num('z')} AS z_score, {num('mx')} AS max_value FROM z WHERE abs(z) >= 3.5""")
def process_anomalies(spark, d):
    return health.process_anomalies(a.readings(spark, d))


# facts of a session before rounding, for the equivalents that go on computing with them
READY_SQL = f"(WITH {_RDY} SELECT session_id, score FROM sc)"
DRIFT_SQL = f"(WITH {_BD} SELECT session_id, n, CASE WHEN n >= 3 THEN m END AS mean_sec, CASE WHEN n >= 3 THEN s END AS slope FROM g)"
SPIKES_SQL = f"(SELECT session_id, count(*) AS c FROM ({SQL['process_anomalies']}) GROUP BY 1)"


@query(f"""SELECT session_id, {num('y.score')} AS readiness, y.grade AS readiness_grade, b.n_layers, b.mean_sec, b.slope_sec_per_layer, coalesce(b.trend, 'insufficient_data') AS trend, coalesce(p.c, 0) AS anomaly_count
FROM ({SQL['readiness']}) y FULL JOIN ({SQL['burn_drift']}) b USING (session_id) LEFT JOIN {SPIKES_SQL} p USING (session_id)""")
def process_health(spark, d):
    return health.process_health(a.readings(spark, d), _layer_times(spark, d))


@query(f"""WITH {a.RD}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id, signal ORDER BY idx DESC) AS r FROM rd)
SELECT session_id, grp AS "group", CAST(bool_or(CASE grp WHEN 'oxygen' THEN value > 150 WHEN 'humidity' THEN value > 120 WHEN 'pressure' THEN value > 200 OR value < 1 ELSE value > 180 END) AS VARCHAR) AS in_alarm
FROM l WHERE r <= 10 GROUP BY 1, 2""")
def tail_alarm(spark, d):
    limits = spark.createDataFrame([("oxygen", 150.0, None), ("humidity", 120.0, None), ("pressure", 200.0, 1.0), ("temperature", 180.0, None)],
                                   "group string, alarm_high double, alarm_low double")
    return health.tail_alarm(a.readings(spark, d), limits)


_LG = f"""{a.ME}, ly AS (SELECT DISTINCT session_id, layer FROM me WHERE layer >= 0), nx AS (SELECT *, lead(layer) OVER (PARTITION BY session_id ORDER BY layer) - layer - 1 AS gap FROM ly),
g AS (SELECT session_id, min(layer) AS lo, max(layer) AS hi, count(*) AS c, max(gap) AS gap, max(layer) - min(layer) + 1 - count(*) AS miss, (max(layer) - min(layer) + 1 - count(*)) / (max(layer) - min(layer) + 1) AS fr FROM nx GROUP BY 1),
lg AS (SELECT * FROM g WHERE c >= 2 AND miss > 0 AND fr >= 0.02)"""


@query(f"""WITH {_LG} SELECT session_id, {big('lo')} AS layer_min, {big('hi')} AS layer_max, c AS present, {big('gap')} AS largest_gap, {big('miss')} AS missing, {num('fr')} AS fraction,
  CASE WHEN fr > 0.1 THEN 'high' ELSE 'medium' END AS severity FROM lg""")
def layer_gaps(spark, d):
    return quality.layer_gaps(a.machine_events(spark, d))


_TG = f"""{a.ME}, st AS (SELECT session_id, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS nx FROM me WHERE family <> 'monitor100_log'),
gp AS (SELECT *, (epoch_us(nx) - epoch_us(ts)) / 1e6 AS gap FROM st),
tgg AS (SELECT session_id, count(*) AS c, count(*) FILTER (gap > 1800) AS n, max(gap) / 60 AS mx FROM gp GROUP BY 1),
w AS (SELECT session_id, ts, nx, row_number() OVER (PARTITION BY session_id ORDER BY gap DESC, ts) AS r FROM gp WHERE gap > 1800),
tg AS (SELECT tgg.*, w.ts, w.nx FROM tgg JOIN w USING (session_id) WHERE r = 1 AND c >= 3)"""


def _stamps(spark, d):
    return a.machine_events(spark, d).where("family <> 'monitor100_log'").select("session_id", "ts", "event_id")


@query(f"""WITH {_TG} SELECT session_id, n AS gaps, {num('mx')} AS max_gap_min, {ts('ts')} AS gap_start, {ts('nx')} AS gap_end, CASE WHEN mx > 120 THEN 'high' ELSE 'medium' END AS severity FROM tg""")
def time_gaps(spark, d):
    return quality.time_gaps(_stamps(spark, d), ["event_id"])


_SF = f"""{a.RD}, ss AS (SELECT session_id, signal, count(*) AS n, stddev_pop(value) AS sd FROM rd GROUP BY 1, 2), mn AS (SELECT session_id, median(n) AS mn FROM ss GROUP BY 1),
sf AS (SELECT session_id, signal, CASE WHEN n >= 50 AND sd = 0 THEN 'sensor_stuck' WHEN mn > 0 AND n < mn * 0.5 THEN 'sensor_dropout' END AS fault FROM ss JOIN mn USING (session_id))"""


def _counts(spark, d):
    return a.readings(spark, d).groupBy("session_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("std"))


@query(f"WITH {_SF} SELECT session_id, signal, fault FROM sf WHERE fault IS NOT NULL")
def sensor_faults(spark, d):
    return quality.sensor_faults(_counts(spark, d))


_MF = f"""{a.ME}, fs AS (SELECT session_id, family FROM me GROUP BY 1, 2 HAVING count(*) >= 10),
pr AS (SELECT session_id, bool_or(family = 'main_event_log') AS m, bool_or(family = 'sensors_log') AS s, bool_or(family = 'time_log') AS t FROM fs GROUP BY 1),
mf AS (SELECT *, CAST(NOT m AS INT) + CAST(NOT s AS INT) + CAST(NOT t AS INT) AS c,
  concat_ws(',', CASE WHEN NOT m THEN 'main_event_log' END, CASE WHEN NOT s THEN 'sensors_log' END, CASE WHEN NOT t THEN 'time_log' END) AS miss FROM pr)"""


def _files(spark, d):
    """A family counts as present when it wrote at least ten rows."""
    rows = a.machine_events(spark, d).groupBy("session_id", "family").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("n >= 10").select("session_id", "family")


@query(f"WITH {_MF} SELECT session_id, miss AS missing, CASE WHEN c > 1 THEN 'high' ELSE 'medium' END AS severity FROM mf WHERE c = 1")
def missing_families(spark, d):
    return quality.missing_families(_files(spark, d))


def _tables(spark, d):
    """Each burn event as a parsed table: k malformed rows above 90, the layer as an unknown column above 95."""
    ev = a.machine_events(spark, d).where("event_type = 'burn_event'")
    tables = ev.select("session_id", F.when(F.col("layer") > 90, F.col("layer")).otherwise(0).alias("malformed_rows"),
                       F.when(F.col("layer") > 95, F.array(F.concat(F.lit("X"), F.col("layer").cast("string")))).otherwise(
                           F.array().cast("array<string>")).alias("unknown_columns"))
    diags = a.machine_events(spark, d).where("event_type = 'pause'").select(
        "session_id", F.when(F.col("layer") > 97, "error").when(F.col("layer") > 95, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("code_"), F.col("layer").cast("string")).alias("code"))
    return tables, diags


_PW = f"""{a.ME}, pw AS (SELECT session_id, coalesce(sum(layer) FILTER (event_type = 'burn_event' AND layer > 90), 0) AS mal,
  coalesce(string_agg(DISTINCT 'X' || layer, ',' ORDER BY 'X' || layer) FILTER (event_type = 'burn_event' AND layer > 95), '') AS unk,
  coalesce(string_agg(DISTINCT 'code_' || layer, ',' ORDER BY 'code_' || layer) FILTER (event_type = 'pause' AND layer > 95), '') AS codes,
  count(DISTINCT layer) FILTER (event_type = 'burn_event' AND layer > 95) AS nu, count(DISTINCT layer) FILTER (event_type = 'pause' AND layer > 95) AS nc FROM me GROUP BY 1),
pc AS (SELECT *, coalesce(nullif(mal, 0), nullif(nu, 0), nullif(nc, 0)) AS c FROM pw)"""


@query(f"WITH {_PW} SELECT session_id, {big('mal')} AS malformed, unk AS unknown_columns, codes, {big('c')} AS count FROM pc WHERE c IS NOT NULL")
def parse_warnings(spark, d):
    return quality.parse_warnings(*_tables(spark, d))


def _issues(spark, d):
    ev = a.machine_events(spark, d)
    return quality.session_issues(_files(spark, d), ev, _stamps(spark, d), _counts(spark, d), *_tables(spark, d))


def _cut(cte: str) -> str:
    """The part of a fragment after the shared base views."""
    base = a.ME if cte.startswith(a.ME) else a.RD
    return cte[len(base):]


_DQ = f"""{a.ME}{_cut(_LG)}{_cut(_TG)}, rd AS (SELECT session_id, event_type AS signal, value FROM me){_cut(_SF)}{_cut(_MF)}{_cut(_PW)},
iss AS (SELECT session_id, 'missing_log_family' AS kind, CASE WHEN c > 1 THEN 'high' ELSE 'medium' END AS severity, c AS cnt, 15.0 AS pen FROM mf WHERE c = 1
  UNION ALL SELECT session_id, 'layer_gaps', CASE WHEN fr > 0.1 THEN 'high' ELSE 'medium' END, miss, 20.0 FROM lg
  UNION ALL SELECT session_id, 'time_gaps', CASE WHEN mx > 120 THEN 'high' ELSE 'medium' END, n, 12.0 FROM tg
  UNION ALL SELECT session_id, fault, 'medium', count(*), 10.0 FROM sf WHERE fault IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT session_id, 'parse_warnings', 'low', c, 8.0 FROM pc WHERE c IS NOT NULL)"""


@query(f"WITH {_DQ} SELECT session_id, kind, severity, {big('cnt')} AS count FROM iss")
def quality_issues(spark, d):
    return _issues(spark, d).drop("detail")


SCORE_SQL = f"""(WITH {_DQ}, sc AS (SELECT session_id, greatest(0, 100 - sum(pen * least(2.0, 1 + log10(greatest(1, cnt))))) AS s FROM iss GROUP BY 1)
SELECT session_id, coalesce(s, 100) AS score FROM (SELECT DISTINCT session_id FROM me) LEFT JOIN sc USING (session_id))"""


@query(f"""WITH {_DQ}, sc AS (SELECT session_id, count(*) AS n, greatest(0, 100 - sum(pen * least(2.0, 1 + log10(greatest(1, cnt))))) AS s FROM iss GROUP BY 1),
al AS (SELECT session_id, coalesce(s, 100) AS s, coalesce(n, 0) AS n FROM (SELECT DISTINCT session_id FROM me) LEFT JOIN sc USING (session_id))
SELECT session_id, {num('s')} AS score, CASE WHEN s >= 85 THEN 'good' WHEN s >= 60 THEN 'fair' ELSE 'poor' END AS grade, n AS issue_count FROM al""")
def data_quality(spark, d):
    return quality.quality_score(a.machine_events(spark, d), _issues(spark, d))


@query(f"""WITH {a.ME}, f AS (SELECT session_id, count(*) AS c, count(*) FILTER (layer = 0) AS e FROM me GROUP BY 1), t AS (SELECT session_id, sum(layer) FILTER (layer > 90) AS m FROM me WHERE event_type = 'burn_event' GROUP BY 1)
SELECT session_id, c AS file_count, e AS empty_file_count, {big('coalesce(m, 0)')} AS malformed_rows, CAST(0 AS BIGINT) AS repeated_headers FROM f LEFT JOIN t USING (session_id)""")
def report_quality(spark, d):
    files = a.machine_events(spark, d).select("session_id", F.col("layer").alias("size_bytes"))
    return quality.report_quality(files, _tables(spark, d)[0].withColumn("repeated_headers", F.lit(0)))


_DK = """floor(epoch_us(ts) / 3600000000) AS b"""


@query(f"""WITH {a.ME}, b AS (SELECT *, {_DK} FROM me),
g AS (SELECT session_id, b, event_type, layer // 10 AS l, subsystem, min(event_id) AS event_id, max(confidence) AS cf, count(*) AS c FROM b GROUP BY 1, 2, 3, 4, 5)
SELECT session_id, event_id, event_type, {big('l')} AS layer, subsystem, {num('cf')} AS confidence, c AS copies FROM g""")
def dedup_events(spark, d):
    ev = a.machine_events(spark, d).withColumn("layer", F.floor(F.col("layer") / 10))
    return features.deduplicate(ev, ["ts", "event_id"], 3600).select(
        "session_id", "event_id", "event_type", "layer", "subsystem", "confidence", "copies")


@query(f"""WITH {a.ME}, b AS (SELECT *, {_DK} FROM me),
g AS (SELECT session_id, event_id, first_value(event_id) OVER w AS kept, count(*) OVER (PARTITION BY session_id, b, event_type, layer // 10, subsystem) AS c FROM b
  WINDOW w AS (PARTITION BY session_id, b, event_type, layer // 10, subsystem ORDER BY ts, event_id))
SELECT session_id, event_id, kept AS kept_event_id, c AS copies FROM g WHERE c > 1""")
def dedup_provenance(spark, d):
    ev = a.machine_events(spark, d).withColumn("layer", F.floor(F.col("layer") / 10))
    p = features.dedup_provenance(ev, ["ts", "event_id"], 3600)
    return p.select("session_id", "event_id", F.col("kept.event_id").alias("kept_event_id"), "copies")


@query(f"WITH {a.ME} SELECT session_id, count(*) AS transition_count, 'state_churn' AS anomaly_type, 'warning' AS severity, {num('0.65')} AS confidence FROM me GROUP BY 1 HAVING count(*) >= 60")
def state_churn(spark, d):
    return features.state_churn(a.transitions(spark, d), threshold=60)


@query(f"""WITH {a.ME}, ud AS (SELECT CAST(session_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS sid, * FROM me),
g AS (SELECT sid, bool_or(event_type IN ('start', 'burn_event')) AS lay, bool_or(event_type = 'resume') AS res, bool_or(subsystem IN ('door', 'glove', 'heating', 'power')) AS sv,
  bool_and(family = 'monitor100_log') AS mon, bool_or(family = 'main_event_log') AS ml, bool_or(event_type = 'pause') AS op FROM ud GROUP BY 1)
SELECT sid AS session_id, CASE WHEN lay AND res THEN 'REAL_PRINT_WITH_RESUME' WHEN lay THEN 'REAL_PRINT' WHEN op OR sv THEN 'SERVICE_SESSION' WHEN mon THEN 'IDLE_DIAGNOSTIC' WHEN ml THEN 'PRE_BURN_SESSION' ELSE 'INCOMPLETE_OR_UNKNOWN' END AS classification,
  {num('CASE WHEN lay AND res THEN 0.82 WHEN lay THEN 0.78 WHEN op THEN 0.7 WHEN sv THEN 0.55 WHEN mon THEN 0.5 WHEN ml THEN 0.45 ELSE 0.2 END')} AS confidence FROM g""")
def classification(spark, d):
    ev = a.machine_events(spark, d).withColumn("session_id", F.concat_ws("-", F.col("session_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    files = ev.select("session_id", "family", F.lit(0).alias("table_rows"))
    work = ev.where("event_type = 'pause'").select("session_id", F.lit("filter_replaced").alias("event_type"))
    return sessions.classify_sessions(ev, files, ev, ev, work).drop("evidence")


@query(f"""WITH {a.EV}, o AS (SELECT user_id AS session_id, k AS layer, arg_min(value, event_id) FILTER (event_type = 'click' AND value > 0) / 1000 AS s1,
  arg_max(event_id, event_id) FILTER (event_type = 'view') - arg_min(event_id, event_id) FILTER (event_type = 'purchase') AS s2 FROM ev GROUP BY 1, 2),
r AS (SELECT session_id, layer, s1 AS v, 0 AS q FROM o WHERE s1 IS NOT NULL UNION ALL SELECT session_id, layer, s2 / 1000, 1 FROM o WHERE s2 > 0),
b AS (SELECT session_id, min(q) AS q FROM r GROUP BY 1)
SELECT session_id, {big('layer')} AS layer, {num('v')} AS duration_sec, CAST(q AS BIGINT) AS source_rank FROM r JOIN b USING (session_id, q)""")
def layer_burn_times(spark, d):
    ev = a.events(spark, d)
    kind = F.col("event_type")
    timing = ev.select(
        F.col("user_id").alias("session_id"), F.col("k").alias("layer"), F.lit("t").alias("source_file_id"), F.col("event_id").alias("source_line"),
        F.lit(0).alias("entry_no"), F.when(kind == "click", "layer_timing_summary").when(kind == "view", "burn_end").when(
            kind == "purchase", "burn_start").otherwise("other").alias("event_type"),
        F.when(kind == "click", F.col("value")).alias("burn_ms"), F.when(kind.isin("view", "purchase"), F.col("event_id")).alias("abs_ms"))
    return features.layer_burn_times(timing)
