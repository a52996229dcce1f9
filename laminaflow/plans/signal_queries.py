"""Signal statistics, ordered kernels and cross-session analytics over the event stream and the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminaflow.functions.scalars import clock_seconds
from laminaflow.operators import cross_session as xs
from laminaflow.operators import features, robust, sessions, slopes
from laminaflow.operators.ordered import group_quantiles
from laminaflow.plans import adapters as a
from laminaflow.plans.catalog import SQL, big, num, query, ts
from laminaflow.sources import logs

KEYS = ["session_id", "signal"]


@query(f"""WITH {a.RD}, {a.DIM},
i AS (SELECT *, row_number() OVER (PARTITION BY session_id, signal ORDER BY idx) - 1 AS p FROM rd),
sl AS (SELECT x.session_id, x.signal, median((y.value - x.value) / (y.p - x.p)) AS s FROM i x JOIN i y ON x.session_id = y.session_id AND x.signal = y.signal AND y.p > x.p GROUP BY 1, 2)
SELECT rd.session_id, rd.signal, any_value(dim.grp) AS "group", count(*) AS n, {num('avg(value)')} AS mean,
  {num('stddev_pop(value)')} AS std, {num('min(value)')} AS min, {num('max(value)')} AS max,
  {big('count(*) FILTER (value > alarm_high) + count(*) FILTER (value < alarm_low)')} AS alarm_count,
  {num('quantile_cont(value, 0.05)')} AS p05, {num('quantile_cont(value, 0.95)')} AS p95,
  {num('quantile_cont(value, 0.99)')} AS p99, {num('any_value(sl.s)')} AS trend_slope
FROM rd JOIN dim USING (signal) JOIN sl ON sl.session_id = rd.session_id AND sl.signal = rd.signal
GROUP BY 1, 2 HAVING count(*) >= 10""")
def signal_stats(spark, d):
    return features.signal_stats(a.readings(spark, d).drop("group"), a.signal_dim(spark))


@query(f"""SELECT l_suppkey AS session_id, l_returnflag || l_linestatus AS signal, count(*) AS n,
  {num('avg(l_extendedprice)')} AS mean, {num('stddev_pop(l_extendedprice)')} AS std,
  {num('min(l_extendedprice)')} AS min, {num('max(l_extendedprice)')} AS max,
  {big('count(*) FILTER (l_extendedprice > 90000) + count(*) FILTER (l_extendedprice < 2000)')} AS alarm_count,
  {num('quantile_cont(l_extendedprice, 0.05)')} AS p05, {num('quantile_cont(l_extendedprice, 0.95)')} AS p95,
  {num('quantile_cont(l_extendedprice, 0.99)')} AS p99
FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 10""")
def signal_stats_lineitem(spark, d):
    rows = a.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), F.concat("l_returnflag", "l_linestatus").alias("signal"),
        F.col("l_extendedprice").alias("value"))
    names = [(f + s, "price", 2000.0, 90000.0) for f in "ANR" for s in "FO"]
    dim = spark.createDataFrame(names, "signal string, group string, alarm_low double, alarm_high double")
    return features.signal_stats(rows, dim, slope=False).drop("group")


@query(f"""WITH {a.RD},
i AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY session_id, signal) AS n FROM rd
  WINDOW w AS (PARTITION BY session_id, signal ORDER BY idx)),
st AS (SELECT *, greatest(1, n // 20) AS step FROM i),
sm AS (SELECT *, lead(value) OVER (PARTITION BY session_id, signal ORDER BY p) AS nx FROM st WHERE p % step = 0),
sl AS (SELECT session_id, signal, median((nx - value) / step) FILTER (nx IS NOT NULL) AS s FROM sm GROUP BY 1, 2),
g AS (SELECT session_id, signal, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn,
  max(value) AS mx, list_sort(list(value)) AS v FROM rd GROUP BY 1, 2)
SELECT g.session_id, g.signal, n, {num('mean')} AS mean, {num('std')} AS std, {num('mn')} AS min, {num('mx')} AS max,
  {num('v[CAST(round_even(CAST(0.05 AS DOUBLE) * (n - 1), 0) AS BIGINT) + 1]')} AS p05_nearest,
  {num('v[CAST(round_even(CAST(0.95 AS DOUBLE) * (n - 1), 0) AS BIGINT) + 1]')} AS p95_nearest,
  {num('coalesce(s, 0)')} AS trend_slope
FROM g JOIN sl USING (session_id, signal) WHERE n >= 5""")
def signal_stats_compact(spark, d):
    return features.compact_signal_stats(a.readings(spark, d))


@query(f"""WITH {a.RD}, {a.DIM}, g AS (SELECT session_id, signal, avg(value) AS m, stddev_pop(value) AS s FROM rd GROUP BY 1, 2)
SELECT session_id, """ + ", ".join(
    f"{num(f'max(m) FILTER (signal = {k!r})')} AS {k}__mean, {num(f'max(s) FILTER (signal = {k!r})')} AS {k}__std"
    for k in a.EVENT_MEANING) + " FROM g GROUP BY 1")
def signal_stats_wide(spark, d):
    st = a.readings(spark, d).groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    st = st.withColumn("start_ts", F.lit(None).cast("timestamp"))
    return features.wide_signal_stats(st, list(a.EVENT_MEANING), ["mean", "std"]).drop("start_ts")


@query(f"""SELECT l_returnflag || l_linestatus AS signal, {num('quantile_cont(l_extendedprice, 0.05)')} AS p05,
  {num('median(l_extendedprice)')} AS p50, {num('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, d):
    rows = a.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("signal"), "l_extendedprice")
    return group_quantiles(rows, ["signal"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


_MAD = f"""{a.RD}, md AS (SELECT session_id, signal, median(value) AS med FROM rd GROUP BY 1, 2),
mm AS (SELECT rd.session_id, rd.signal, any_value(med) AS med, median(abs(value - med)) AS mad
  FROM rd JOIN md ON rd.session_id = md.session_id AND rd.signal = md.signal GROUP BY 1, 2)"""


@query(f"""WITH {_MAD} SELECT session_id, signal, idx, {num('med')} AS med, {num('mad')} AS mad,
  {num('CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (value - med) / mad END')} AS robust_z FROM rd JOIN mm USING (session_id, signal)""")
def robust_z(spark, d):
    return robust.robust_z(a.readings(spark, d), KEYS, "value").drop("group", "ts", "value")


@query(f"""WITH {a.RD}, g AS (SELECT session_id, signal, avg(value) AS m, stddev_pop(value) AS s FROM rd GROUP BY 1, 2)
SELECT session_id, signal, idx, {num('CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (value - m) / s END')} AS z
FROM rd JOIN g USING (session_id, signal)""")
def zscore(spark, d):
    return robust.z_score(a.readings(spark, d), KEYS, "value").select(*KEYS, "idx", "z")


@query(f"""WITH {a.RD} SELECT signal, idx, {num('median(value) OVER (PARTITION BY signal ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS baseline
FROM rd""")
def rolling_median(spark, d):
    return robust.rolling_median(a.readings(spark, d), ["signal"], ["idx"], "value").select("signal", "idx", "baseline")


@query(f"""WITH {_MAD}, dv AS (SELECT rd.*, med, mad, abs(value - med) AS dev FROM rd JOIN mm USING (session_id, signal)),
pk AS (SELECT *, row_number() OVER (PARTITION BY session_id, signal ORDER BY dev DESC, idx) AS rf,
  row_number() OVER (PARTITION BY session_id, signal ORDER BY dev DESC, idx DESC) AS rl FROM dv),
g AS (SELECT session_id, signal, count(*) AS n, any_value(med) AS med, any_value(mad) AS mad, max(value) AS mx,
  max(value) FILTER (rf = 1) AS pv, max(idx) FILTER (rf = 1) AS pi, stddev_pop(value) FILTER (rl <> 1) AS rest FROM pk GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN mad > 0 THEN 0.6745 * (pv - med) / mad WHEN rest > 0 THEN (pv - med) / rest WHEN pv <> med THEN 99 END AS z FROM g WHERE n >= 5)
SELECT session_id, signal, n, {num('med')} AS med, {num('mad')} AS mad, {num('mx')} AS max_value, pi AS peak_idx,
  {num('pv')} AS peak, {num('z')} AS z_score FROM z WHERE z IS NOT NULL""")
def robust_spike(spark, d):
    return robust.robust_spike(a.readings(spark, d), KEYS, "idx", "value")


def _all_pairs_sql(src: str, key: str, order: str, value: str) -> str:
    """Median of the slopes of all pairs."""
    return f"""n0 AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS p, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
ps AS (SELECT x.{key}, median((y.v - x.v) / (y.p - x.p)) AS s FROM n0 x JOIN n0 y ON x.{key} = y.{key} AND y.p > x.p GROUP BY 1),
slope AS (SELECT {key}, any_value(n) AS n, coalesce(any_value(s), 0) AS s FROM n0 LEFT JOIN ps USING ({key}) GROUP BY 1)"""


def _pairs_sql(src: str, key: str, order: str, value: str, cap: int = 2000) -> str:
    """Theil-Sen by pairs over the evenly thinned series."""
    return f"""n0 AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS p,
  count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
pos AS (SELECT {key}, n, CAST(round_even(i * (CAST(n - 1 AS DOUBLE) / {cap - 1}), 0) AS BIGINT) AS p
  FROM (SELECT DISTINCT {key}, n FROM n0 WHERE n > {cap}), range({cap}) r(i)),
th AS (SELECT {key}, n, p, v FROM n0 WHERE n <= {cap} UNION ALL SELECT n0.{key}, n0.n, n0.p, v FROM n0 JOIN pos ON n0.{key} = pos.{key} AND n0.p = pos.p),
slope AS (SELECT x.{key}, any_value(x.n) AS n, least(any_value(x.n), {cap}) AS used, median((y.v - x.v) / (y.p - x.p)) AS s
  FROM th x JOIN th y ON x.{key} = y.{key} AND y.p > x.p GROUP BY 1)"""


@query(f"""WITH {a.UD}, {_pairs_sql('ud', 'signal', 'start_ts, session_id', 'mean')} SELECT signal, n, used AS n_used, {num('s')} AS slope FROM slope""")
def theil_sen(spark, d):
    return robust.theil_sen(a.user_day_stats(spark, d), ["signal"], xs.ORDER, "mean", 2000)


def _slope_sql(src: str, key: str, order: str, value: str) -> str:
    return f"""n0 AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS p FROM {src}),
slope AS (SELECT {key}, count(*) AS n, coalesce(regr_slope(v, p), 0) AS s FROM n0 GROUP BY 1)"""


@query(f"""WITH {a.UD}, {_all_pairs_sql('ud', 'signal', 'start_ts, session_id', 'mean')} SELECT signal, n, {num('s')} AS slope FROM slope""")
def theil_sen_all_pairs(spark, d):
    return slopes.theil_sen(a.user_day_stats(spark, d), ["signal"], xs.ORDER, "mean")


@query(f"""WITH {a.UD}, {_slope_sql('ud', 'signal', 'start_ts, session_id', 'mean')} SELECT signal, n, {num('s')} AS slope FROM slope""")
def position_slope(spark, d):
    return robust.position_slope(a.user_day_stats(spark, d), ["signal"], xs.ORDER, "mean")


@query(f"""WITH {a.RD}, i AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY idx) - 1 AS p, count(*) OVER (PARTITION BY signal) AS n FROM rd),
pos AS (SELECT signal, CAST(round_even(q * (n - 1) / CAST(149 AS DOUBLE), 0) AS BIGINT) AS p FROM (SELECT DISTINCT signal, n FROM i WHERE n > 150), range(150) r(q))
SELECT signal, p AS idx, n, {num('value')} AS value FROM i WHERE n <= 150 OR (signal, p) IN (SELECT signal, p FROM pos)""")
def even_sample(spark, d):
    rows = a.readings(spark, d).select("signal", F.col("idx").alias("event_id"), "value")
    return robust.even_sample(rows, ["signal"], ["event_id"]).drop("event_id")


@query(f"""WITH {a.RD}, i AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY idx) - 1 AS p, count(*) OVER (PARTITION BY signal) AS n FROM rd),
pos AS (SELECT signal, CAST(floor(q * (n / CAST(150 AS DOUBLE))) AS BIGINT) AS p FROM (SELECT DISTINCT signal, n FROM i WHERE n > 150), range(150) r(q))
SELECT signal, p AS idx, n, {num('value')} AS value FROM i WHERE n <= 150 OR (signal, p) IN (SELECT signal, p FROM pos)""")
def step_sample(spark, d):
    rows = a.readings(spark, d).select("signal", F.col("idx").alias("event_id"), "value")
    return robust.step_sample(rows, ["signal"], ["event_id"]).drop("event_id")


@query(f"""WITH {a.ME}, i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY session_id) AS n,
  event_type IN ('pause', 'resume') AS urgent FROM me),
o AS (SELECT *, rn > 10 AND NOT urgent AS other, sum(CASE WHEN rn > 10 AND NOT urgent THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS ko FROM i),
t AS (SELECT session_id, count(*) FILTER (other) AS others, 50 - 10 - count(*) FILTER (rn > 10 AND urgent) AS budget FROM o GROUP BY 1),
s AS (SELECT o.*, CASE WHEN n <= 50 THEN 'all' WHEN rn <= 10 THEN 'head' WHEN urgent THEN 'priority'
  WHEN budget > 0 AND (ko - 1) % greatest(1, others // budget) = 0 AND (ko - 1) // greatest(1, others // budget) < budget THEN 'sample' END AS shown
  FROM o JOIN t USING (session_id))
SELECT session_id, event_id, event_type, shown AS shown_as, n AS total_events FROM s WHERE shown IS NOT NULL
UNION ALL SELECT session_id, NULL, '_truncated', 'marker', count(*) FROM me GROUP BY 1 HAVING count(*) > 50""")
def timeline_preview(spark, d):
    ev = a.machine_events(spark, d).select("session_id", "event_id", "ts", "event_type")
    return robust.timeline_preview(ev, ["session_id"], ["ts", "event_id"], cap=50, head=10).drop("ts")


@query(f"""WITH {a.EV}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 36 HOUR THEN 1 ELSE 0 END AS f FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)
SELECT user_id, {big('session_no')} AS session_no, count(*) AS events, {ts('min(ts)')} AS start_ts, {ts('max(ts)')} AS end_ts FROM n GROUP BY 1, 2""")
def gap_sessions(spark, d):
    rows = sessions.gap_sessions(a.events(spark, d), ["user_id"], "ts", ["event_id"])
    return rows.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


_FILES = f"""{a.EV}, f AS (SELECT *, 'log_' || CAST(event_id AS VARCHAR) || '_' || event_type || '.log' AS name, {a._sql_case(1)} AS family FROM ev),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 36 HOUR THEN 1 ELSE 0 END AS fl FROM f
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, name)),
n AS (SELECT *, sum(fl) OVER (PARTITION BY user_id ORDER BY ts, name) AS session_no FROM g)"""


def _file_groups(spark, d):
    ev = a.events(spark, d)
    files = ev.select(
        F.col("event_id").alias("file_id"), "user_id", F.col("ts").alias("mtime"), F.lit(None).cast("date").alias("name_date"),
        a.meaning(1).alias("family"), F.concat(F.lit("log_"), F.col("event_id").cast("string"), F.lit("_"), "event_type", F.lit(".log")).alias("name"))
    stamps = ev.select(F.col("event_id").alias("file_id"), "ts")
    return sessions.group_files(files, stamps, ["user_id"])


@query(f"""WITH {_FILES} SELECT user_id, {big('session_no')} AS session_no,
  'session_' || strftime(min(ts), '%Y%m%d') || '_' || substr(sha256(string_agg(name, '|' ORDER BY name)), 1, 8) AS session_id,
  {ts('min(ts)')} AS start_ts, {ts('max(ts)')} AS end_ts, count(*) AS file_count,
  {num("0.35 + CASE WHEN bool_or(family = 'main_event_log') THEN 0.15 ELSE 0 END + CASE WHEN bool_or(family = 'stateflow_log') THEN 0.2 ELSE 0 END + CASE WHEN bool_or(family = 'monitor100_log') THEN 0.1 ELSE 0 END")} AS grouping_confidence
FROM n GROUP BY 1, 2""")
def file_groups(spark, d):
    return _file_groups(spark, d)[1].drop("families")


@query(f"""WITH {_FILES} SELECT event_id AS file_id, user_id, {big('session_no')} AS session_no,
  CASE WHEN fl = 0 THEN 'temporal_continuity' WHEN session_no > 1 THEN 'new_gap_exceeded' END AS reason FROM n""")
def file_assignment(spark, d):
    return _file_groups(spark, d)[0].select("file_id", "user_id", "session_no", "reason")


@query(f"""WITH {a.ME}, p AS (SELECT *, CASE WHEN event_type LIKE '%burn%' THEN 'burn' WHEN event_type LIKE '%pour%' THEN 'pour' WHEN event_type = 'pause' THEN 'pause'
  WHEN event_type = 'resume' THEN 'restart_attempts' END AS ph FROM me),
q AS (SELECT *, CASE WHEN lag(ph) OVER w = ph THEN 0 ELSE 1 END AS f FROM p WHERE ph IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS sn FROM q),
g AS (SELECT session_id, sn, any_value(ph) AS phase, min(ts) AS t0, max(ts) AS t1, count(*) AS c, arg_min(layer, event_id) AS l0, arg_max(layer, event_id) AS l1,
  arg_min(confidence, event_id) AS cf FROM r GROUP BY 1, 2),
h AS (SELECT *, lead(t0) OVER (PARTITION BY session_id ORDER BY sn) AS nx FROM g)
SELECT session_id, {big('sn')} AS segment_no, phase, {ts('t0')} AS ts_start, {ts('coalesce(nx, CASE WHEN c > 1 THEN t1 END)')} AS ts_end,
  {big('l0')} AS layer_start, {big('l1')} AS layer_end, {num('cf')} AS confidence, c AS event_count FROM h""")
def phase_segments(spark, d):
    return features.phase_segments(a.machine_events(spark, d), None, ["event_id"])


@query(f"""WITH {a.EV}, st AS (SELECT user_id, event_id, ts, event_type AS a, CAST(floor(k / 50) AS BIGINT) AS b FROM ev),
c AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
kept AS (SELECT * FROM c WHERE rn = 1 OR a <> pa OR b <> pb),
l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS t0 FROM kept)
SELECT user_id, event_id, {ts('t0')} AS ts_start, {ts('ts')} AS ts_end, {num('greatest(epoch_us(ts) - epoch_us(t0), 0) / 1e6')} AS duration_sec,
  CASE WHEN a <> pa AND b <> pb THEN 'State,ChamberDoor' WHEN a <> pa THEN 'State' ELSE 'ChamberDoor' END AS changed_columns,
  CASE WHEN a <> pa THEN pa END AS old_state, CASE WHEN a <> pa THEN a END AS new_state, CASE WHEN a <> pa THEN 'automation' ELSE 'chamber' END AS subsystem
FROM l WHERE rn > 1""")
def state_transitions(spark, d):
    rows = a.events(spark, d).select(
        "user_id", "event_id", "ts", F.array(F.lit("State"), F.lit("ChamberDoor")).alias("columns"),
        F.array(F.col("event_type"), F.floor(F.col("k") / 50).cast("string")).alias("state"))
    t = logs.state_transitions(rows, ["user_id"], ["event_id"])
    return t.select("user_id", "event_id", "ts_start", "ts_end", "duration_sec", "changed_columns",
                    F.try_element_at("previous_state", F.lit("State")).alias("old_state"),
                    F.try_element_at("new_state", F.lit("State")).alias("new_state"), "subsystem")


@query(f"""WITH {a.EV}, c AS (SELECT user_id, event_id, TIMESTAMP '2024-01-01' + (ts - date_trunc('day', ts)) AS clk FROM ev),
f AS (SELECT *, CASE WHEN clk + INTERVAL 12 HOUR < lag(clk) OVER w THEN 1 ELSE 0 END AS d FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, {ts('clk + to_days(CAST(sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER))')} AS ts FROM f""")
def rollover(spark, d):
    micros = F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", F.col("ts")))
    clock = a.events(spark, d).select("user_id", "event_id", F.timestamp_micros(
        F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + micros).alias("ts"))
    return logs.midnight_rollover(clock, ["user_id"], ["event_id"])


@query(f"""WITH {a.DS}, {_all_pairs_sql('ds', 'signal', 'start_ts, session_id', 'mean')}, m AS (SELECT signal, avg(mean) AS m, any_value(grp) AS grp FROM ds GROUP BY 1),
r AS (SELECT signal, grp, n, s, m, abs(s / m * 100) AS pct FROM slope JOIN m USING (signal) WHERE n >= 3 AND abs(m) >= 1e-9)
SELECT 'trend' AS type, signal, grp AS "group", CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, {num('s')} AS slope_per_session,
  {num('pct')} AS slope_pct_of_mean, n AS n_sessions, {num('m')} AS mean_overall, {num('least(0.95, 0.35 + 0.08 * n + pct / 200)')} AS confidence
FROM r WHERE pct >= 5""")
def signal_trends(spark, d):
    return xs.signal_trends(a.day_stats(spark, d))


@query(f"""WITH {a.DS}, md AS (SELECT signal, median(mean) AS med, count(*) AS ns, avg(mean) AS bm FROM ds GROUP BY 1),
dv AS (SELECT ds.*, med, ns, bm, abs(mean - med) AS dev FROM ds JOIN md USING (signal)), mm AS (SELECT signal, median(dev) AS mad, max(dev) AS far FROM dv GROUP BY 1),
z AS (SELECT dv.*, CASE WHEN mad > 0 THEN 0.6745 * (mean - med) / mad WHEN far > 0 THEN (mean - med) / (far / 10) ELSE 0 END AS z FROM dv JOIN mm USING (signal) WHERE ns >= 3)
SELECT 'session_anomaly' AS type, session_id, signal, grp AS "group", {num('mean')} AS value, {num('bm')} AS baseline_mean, {num('z')} AS z_score,
  CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction, {num('least(0.9, 0.4 + abs(z) / 10)')} AS confidence FROM z WHERE abs(z) >= 2.5""")
def session_outliers(spark, d):
    return xs.session_outliers(a.day_stats(spark, d))


@query(f"""WITH {a.DS}, {_all_pairs_sql('ds', 'signal', 'start_ts, session_id', 'mean')}, c AS (SELECT signal, arg_max(mean, start_ts) AS cur, avg(mean) AS av, any_value(grp) AS grp FROM ds GROUP BY 1),
t AS (SELECT signal, grp, n, s, cur, CASE WHEN s > 0 THEN 100.0 ELSE 20.0 END AS lim FROM slope JOIN c USING (signal)
  WHERE n >= 4 AND abs(s) >= 0.005 * CASE WHEN av = 0 THEN 1 ELSE abs(av) END AND s <> 0),
h AS (SELECT *, CASE WHEN (s > 0 AND lim - cur <= 0) OR (s < 0 AND lim - cur >= 0) THEN 0 ELSE (lim - cur) / s END AS hz FROM t)
SELECT signal, grp AS "group", CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, {num('s')} AS slope_per_session, {num('cur')} AS current_mean,
  {num('lim')} AS threshold, CASE WHEN s > 0 THEN 'alarm_high' ELSE 'alarm_low' END AS threshold_kind, {num('hz')} AS sessions_to_threshold, n AS n_sessions
FROM h WHERE hz <= 200""")
def maintenance_forecast(spark, d):
    stats = a.day_stats(spark, d)
    limits = stats.select("signal").distinct().select("signal", F.lit(100.0).alias("alarm_high"), F.lit(20.0).alias("alarm_low"))
    return xs.maintenance_forecast(stats, limits)


def _service(spark, d):
    return a.events(spark, d).where("event_type = 'error'").select(
        "event_id", F.col("user_id").cast("string").alias("machine"), F.col("ts").alias("event_ts"), F.lit("filter_replaced").alias("event_type"))


@query(f"""WITH {a.DS}, ud AS (SELECT *, split_part(signal, '-', 2) AS machine FROM ds), se AS (SELECT event_id, CAST(user_id AS VARCHAR) AS machine, ts FROM ev WHERE event_type = 'error'),
b AS (SELECT event_id, ts, signal, mean, grp, row_number() OVER (PARTITION BY event_id, signal ORDER BY start_ts DESC, session_id DESC) AS r FROM se JOIN ud ON ud.machine = se.machine AND ud.start_ts < se.ts),
f AS (SELECT event_id, ts, signal, mean, grp, row_number() OVER (PARTITION BY event_id, signal ORDER BY start_ts, session_id) AS r FROM se JOIN ud ON ud.machine = se.machine AND ud.start_ts >= se.ts),
bb AS (SELECT event_id, ts, signal, any_value(grp) AS grp, avg(mean) AS bm, count(*) AS nb FROM b WHERE r <= 5 GROUP BY 1, 2, 3),
ff AS (SELECT event_id, signal, avg(mean) AS am, count(*) AS na FROM f WHERE r <= 5 GROUP BY 1, 2),
j AS (SELECT *, round((am - bm) / abs(bm) * 100, 1) AS dp FROM bb JOIN ff USING (event_id, signal) WHERE abs(bm) >= 1e-9)
SELECT 'before_after' AS type, event_id, 'filter_replaced' AS event_type, {ts('ts')} AS event_ts, signal, grp AS "group", {num('bm')} AS before_mean, {num('am')} AS after_mean,
  {num('dp')} AS delta_pct, nb AS n_before, na AS n_after, {num('least(0.95, 0.35 + 0.08 * (nb + na) + abs(dp) / 200)')} AS confidence FROM j WHERE abs(dp) >= 20""")
def before_after_events(spark, d):
    return xs.before_after(_machine_days(spark, d), _service(spark, d), on=["machine"])


def _machine_days(spark, d):
    """Channels of the days, each of the machine (user) in its name."""
    return a.day_stats(spark, d).withColumn("machine", F.element_at(F.split("signal", "-"), -1))


# per signal: values less their mean, running sums, then the least cost up to every fifth place, from all earlier ones
_SHIFTS = f"""WITH RECURSIVE {a.DS}, f AS (SELECT signal, any_value(grp) AS grp, count(*) AS n, avg(mean) AS m, var_pop(mean) AS va FROM ds GROUP BY 1),
w AS (SELECT signal, session_id, mean - m AS v, row_number() OVER o - 1 AS p, sum(mean - m) OVER o AS s, sum((mean - m) * (mean - m)) OVER o AS q FROM ds JOIN f USING (signal)
  WINDOW o AS (PARTITION BY signal ORDER BY start_ts, session_id ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT signal, p AS t, s - v AS s, q - v * v AS q FROM w WHERE p = 0 OR (p % 5 = 0 AND p >= 2) UNION ALL SELECT signal, p + 1, s, q FROM w JOIN f USING (signal) WHERE p + 1 = n),
arr AS (SELECT signal, list(t ORDER BY t) AS ts, list(s ORDER BY t) AS ss, list(q ORDER BY t) AS qs FROM pt GROUP BY 1),
dp AS (SELECT signal, 1 AS i, [-3 * CASE WHEN va = 0 THEN 1e-12 ELSE va END] AS best, [CAST(0 AS BIGINT)] AS came FROM f
  UNION ALL SELECT signal, i, list_append(best, list_min(c) + pen), list_append(came, list_position(c, list_min(c))) FROM (
    SELECT dp.signal, i + 1 AS i, best, came, 3 * CASE WHEN va = 0 THEN 1e-12 ELSE va END AS pen,
      [CASE WHEN ts[i + 1] - ts[j] >= 2 THEN best[j] + greatest(qs[i + 1] - qs[j] - (ss[i + 1] - ss[j]) * (ss[i + 1] - ss[j]) / (ts[i + 1] - ts[j]), 0) ELSE CAST('inf' AS DOUBLE) END FOR j IN range(1, i + 1)] AS c
    FROM dp JOIN arr USING (signal) JOIN f USING (signal) WHERE i < len(ts))),
fin AS (SELECT dp.signal, came, i FROM dp JOIN arr USING (signal) WHERE i = len(ts)),
cut AS (SELECT signal, came, CAST(i AS BIGINT) AS ix FROM fin UNION ALL SELECT signal, came, came[ix] FROM cut WHERE came[ix] > 1),
pos AS (SELECT cut.signal, ix, ts[ix] AS p, ss[ix] AS s, lead(ts[ix], 1, 0) OVER (PARTITION BY cut.signal ORDER BY ix DESC) AS p0, lead(ss[ix], 1, 0) OVER (PARTITION BY cut.signal ORDER BY ix DESC) AS s0,
  ss[len(ss)] AS z FROM cut JOIN arr USING (signal)),
lv AS (SELECT pos.signal, grp, n, p, m + (s - s0) / (p - p0) AS lb, m + (z - s) / (n - p) AS la FROM pos JOIN f USING (signal) WHERE p < n AND n >= 6),
j AS (SELECT *, abs((la - lb) / lb * 100) AS jp FROM lv WHERE abs(lb) >= 1e-9)
SELECT 'shift' AS type, j.signal, grp AS "group", CASE WHEN la > lb THEN 'up' ELSE 'down' END AS direction, session_id AS at_session, j.p AS session_index, {num('lb')} AS level_before, {num('la')} AS level_after,
  {num('jp')} AS jump_pct, n AS n_sessions, {num('least(0.95, 0.35 + 0.08 * n + jp / 200)')} AS confidence FROM j JOIN w ON w.signal = j.signal AND w.p = j.p WHERE jp >= 10"""


@query(_SHIFTS)
def signal_shifts(spark, d):
    return xs.signal_shifts(a.day_stats(spark, d))


@query("SELECT type, count(*) AS findings, max(confidence) AS best_confidence FROM (" + " UNION ALL ".join(
    f"SELECT type, confidence FROM ({SQL[k]})" for k in ("signal_trends", "before_after_events", "session_outliers", "signal_shifts")) + ") GROUP BY 1")
def cross_session_summary(spark, d):
    return xs.findings_summary(xs.cross_session_findings(_machine_days(spark, d), _service(spark, d), ["machine"]))


@query(f"""WITH {a.EV} SELECT event_id, {num('extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))')} AS seconds FROM ev""")
def clock_text(spark, d):
    return a.events(spark, d).select("event_id", clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"))
