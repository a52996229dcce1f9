"""Raw text: lines are rebuilt from the event stream and parsed back, documents and conversations are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.journal import parse_messages
from laminaflow.functions.logtext import EVENT_PHRASES, event_kind, guess_encoding, looks_binary
from laminaflow.operators.ordered import Series
from laminaflow.plans import adapters as a
from laminaflow.plans.catalog import big, num, query, ts
from laminaflow.sources import files, logs, tables


def _lines(spark, d, text: Column, header: str | None = None) -> DataFrame:
    """One log file per user: an optional header line and one line per event."""
    s = Series(a.events(spark, d), ["user_id"], ["event_id"]).with_row_number("rn")
    rows = s.frame.select(F.col("user_id").cast("string").alias("source_file_id"), (F.col("rn") + (1 if header else 0)).alias("line_no"), text.alias("line"))
    if header is None:
        return rows
    heads = a.events(spark, d).select(F.col("user_id").cast("string").alias("source_file_id")).distinct()
    return rows.unionByName(heads.select("source_file_id", F.lit(1).cast("long").alias("line_no"), F.lit(header).alias("line")))


def _by_type(**texts: Column) -> Column:
    out = None
    for kind, text in texts.items():
        cond = F.col("event_type") == kind
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


_RN = a.EV + ", rn AS (SELECT *, CAST(user_id AS VARCHAR) AS source_file_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev)"


def _cell() -> Column:
    return F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))


def _clock() -> Column:
    return F.date_format("ts", "HH:mm:ss")


@query(f"""WITH {_RN} SELECT source_file_id, rn AS idx, CASE event_type WHEN 'signup' THEN 'SO1' WHEN 'click' THEN 'SO2' ELSE 'ST3' END AS signal, {num('value')} AS value FROM rn WHERE event_type IN ('signup', 'click', 'view')""")
def parse_sensor_lines(spark, d):
    t, v = _clock(), _cell()
    text = _by_type(
        signup=F.concat(t, F.lit(" | "), v, F.lit(" |   | |x|")), click=F.concat(t, F.lit("||"), v, F.lit("||x|")),
        view=F.concat(t, F.lit("|||"), v, F.lit("|x|")), purchase=F.concat(t, F.lit("||||"), v, F.lit("|")), error=F.concat(t, F.lit("|abc|")))
    return tables.sensor_readings(_lines(spark, d, text, "Time| SO1|SO2 |ST3|Mystery|"))


def _table(spark, d):
    k, v = F.col("k").cast("string"), _cell()
    text = _by_type(signup=F.lit("Layer;SO1;Mystery"), click=F.lit("bad;row"), view=F.concat(k, F.lit(";"), v, F.lit(";abc")),
                    purchase=F.concat(k, F.lit(";"), v, F.lit(";;extra")), error=F.concat(F.lit(" "), k, F.lit(" ;2000000; ")))
    return tables.parse_table(_lines(spark, d, text, "Layer;SO1;Mystery"))


@query(f"""WITH {a.EV} SELECT CAST(user_id AS VARCHAR) AS source_file_id, count(*) FILTER (event_type <> 'signup') AS total_rows, count(*) FILTER (event_type IN ('click', 'purchase')) AS malformed_rows,
  count(*) FILTER (event_type = 'signup') AS repeated_headers, 'Mystery' AS unknown_columns FROM ev GROUP BY 1""")
def parse_table_lines(spark, d):
    return tables.table_summary(_table(spark, d), ["Layer", "SO1"])


@query(f"""WITH {_RN} SELECT source_file_id, rn + 1 AS line_no, p AS position, CASE p WHEN 0 THEN 'Layer' WHEN 1 THEN 'SO1' ELSE 'Mystery' END AS "column",
  {num("CASE WHEN event_type = 'click' THEN NULL WHEN p = 0 THEN k WHEN p = 1 THEN CASE WHEN event_type = 'error' THEN 2000000 ELSE value END END")} AS number,
  CASE WHEN event_type = 'click' THEN CASE p WHEN 0 THEN 'bad' WHEN 1 THEN 'row' END WHEN p = 2 THEN CASE WHEN event_type = 'view' THEN 'abc' END END AS word
FROM rn, range(3) r(p) WHERE event_type <> 'signup'""")
def parse_table_cells(spark, d):
    cells = tables.table_cells(_table(spark, d))
    return cells.select("source_file_id", "line_no", "position", "column", "number", F.when(F.col("number").isNull(), F.col("text")).alias("word"))


@query(f"""WITH {_RN} SELECT source_file_id, rn + 1 AS source_line, 'warning' AS severity, 'malformed_row' AS code, CASE WHEN event_type = 'click' THEN 'Expected 3 columns, found 2.' ELSE 'Expected 3 columns, found 4.' END AS message
FROM rn WHERE event_type IN ('click', 'purchase')""")
def table_diagnostics(spark, d):
    return tables.table_diagnostics(_table(spark, d)).drop("context")


@query(f"""WITH {_RN}, n AS (SELECT source_file_id, event_type, row_number() OVER (PARTITION BY source_file_id ORDER BY rn) AS r FROM rn WHERE event_type <> 'signup')
SELECT source_file_id, count(*) FILTER (event_type = 'error') AS startup_bad_rows FROM n WHERE r <= 100 GROUP BY 1""")
def startup_garbage(spark, d):
    return tables.startup_garbage(_table(spark, d), 100)


def _monitor(spark, d):
    stamp, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("k").cast("string")
    v = F.col("value").cast("string")
    text = _by_type(
        signup=F.concat(stamp, F.lit(" |S|"), k, F.lit("|"), v, F.lit("|door|")), click=F.concat(stamp, F.lit(" |R|"), v, F.lit("| "), k, F.lit(" |")),
        view=F.concat(stamp, F.lit(" A"), k, F.lit("="), v), purchase=F.concat(stamp, F.lit(" B1=0 "), stamp, F.lit(" B1=1")), error=F.concat(F.lit("no stamp at all "), k))
    return logs.parse_monitor_log(_lines(spark, d, text))


_MN = f"""{_RN}, m AS (SELECT source_file_id, rn AS source_line, e AS entry_no, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS t,
  CASE event_type WHEN 'signup' THEN 'monitor_state_change' WHEN 'click' THEN 'monitor_reading' WHEN 'view' THEN 'monitor_code:A' || k WHEN 'purchase' THEN 'monitor_code:B1' ELSE 'monitor_transition' END AS event_type,
  CASE event_type WHEN 'signup' THEN CAST(k AS VARCHAR) END AS signal_id, CASE event_type WHEN 'purchase' THEN CAST(e AS VARCHAR) END AS val, CASE WHEN event_type = 'error' THEN 0.65 ELSE 0.9 END AS cf
  FROM rn, range(2) r(e) WHERE e = 0 OR event_type = 'purchase')"""


@query(f"WITH {_MN} SELECT source_file_id, source_line, entry_no, {ts('t')} AS ts, event_type, signal_id, val AS code_value, {num('cf')} AS confidence FROM m")
def parse_monitor_lines(spark, d):
    m = _monitor(spark, d)
    pick = lambda k: F.try_element_at("payload", F.lit(k))
    return m.select("source_file_id", "source_line", "entry_no", "ts", "event_type", pick("signal_id").alias("signal_id"),
                    F.when(F.col("event_type") == "monitor_code:B1", F.when(F.contains("raw_excerpt", F.lit(" B1=")), pick("value"))).alias("code_value"), "confidence")


@query(f"WITH {_MN} SELECT source_file_id, event_type, count(*) AS n FROM m GROUP BY 1, 2")
def monitor_type_counts(spark, d):
    return logs.monitor_type_counts(_monitor(spark, d))


def _timing_lines(spark, d):
    k, e = F.col("k").cast("string"), F.col("event_id").cast("string")
    ms = (F.col("event_id") + F.col("k")).cast("string")
    text = _by_type(
        signup=F.concat(F.lit("  N|  poor|  burn|make layer|OLD_STATS:  "), k, F.lit("|  8829| "), e, F.lit("| 49250|")),
        click=F.concat(F.lit("NEW_STATS: L"), k, F.lit("_detailed|Burn_Start:"), e, F.lit("|Burn_End:"), ms, F.lit("|Other_Key:5|")),
        view=F.concat(F.lit("OLD_STATS: "), k, F.lit("| broken")), purchase=F.lit("free text"), error=F.lit("NEW_STATS: garbage"))
    return _lines(spark, d, text)


@query(f"""WITH {_RN} SELECT source_file_id, rn AS source_line, 0 AS entry_no, {big('k')} AS layer, 'layer' AS phase, 'layer_timing_summary' AS event_type, event_id AS burn_ms, NULL AS abs_ms FROM rn WHERE event_type = 'signup'
UNION ALL SELECT source_file_id, rn, e, {big('k')}, CASE WHEN e < 2 THEN 'burn' ELSE 'layer' END, CASE e WHEN 0 THEN 'burn_start' WHEN 1 THEN 'burn_end' ELSE 'time_other_key' END, NULL, CASE e WHEN 0 THEN event_id WHEN 1 THEN event_id + k ELSE 5 END FROM rn, range(3) r(e) WHERE event_type = 'click'""")
def parse_timing_lines(spark, d):
    return logs.parse_timing_log(_timing_lines(spark, d)).select("source_file_id", "source_line", "entry_no", "layer", "phase", "event_type", "burn_ms", "abs_ms")


@query(f"WITH {a.EV} SELECT CAST(user_id AS VARCHAR) AS source_file_id, count(*) AS malformed FROM ev WHERE event_type IN ('view', 'error') GROUP BY 1")
def timing_malformed(spark, d):
    return logs.timing_malformed(_timing_lines(spark, d))


def _event_lines(spark, d):
    t, k = _clock(), F.col("k").cast("string")
    text = _by_type(
        signup=F.concat(t, F.lit(" Старт  Ноль = -"), k), click=F.concat(t, F.lit(" -45878 "), k, F.lit(" Прожиг")),
        view=F.concat(t, F.lit(" Отсыпка слоя c опусканием, текущая позиция стола "), k), purchase=F.concat(F.lit("слой "), k, F.lit(" LIR=0,45")), error=F.concat(t, F.lit(" ПАУЗА")))
    return _lines(spark, d, text).withColumn("day", F.lit("2024-01-01").cast("date"))


@query(f"""WITH {_RN}, c AS (SELECT *, CASE WHEN event_type <> 'purchase' THEN TIMESTAMP '2024-01-01' + (date_trunc('second', ts) - date_trunc('day', ts)) END AS clk FROM rn),
p AS (SELECT *, last_value(clk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM c),
s AS (SELECT *, sum(CASE WHEN clk + INTERVAL 12 HOUR < pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS dd FROM p)
SELECT source_file_id, rn AS source_line, {ts('clk + to_days(CAST(dd AS INTEGER))')} AS ts, {num("CASE WHEN clk IS NULL THEN 0 ELSE 86400 END")} AS ts_uncertainty, {big("CASE WHEN event_type IN ('click', 'purchase') THEN k END")} AS layer,
  CASE event_type WHEN 'signup' THEN 'init' WHEN 'click' THEN 'burn' WHEN 'view' THEN 'pour' WHEN 'error' THEN 'pause' END AS phase,
  CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'click' THEN 'burn_event' WHEN 'view' THEN 'layer_pour' WHEN 'error' THEN 'pause' ELSE 'layer_reference' END AS event_type, {num('CASE WHEN clk IS NULL THEN 0.75 ELSE 0.95 END')} AS confidence,
  CASE event_type WHEN 'click' THEN '-45878' WHEN 'view' THEN CAST(k AS VARCHAR) END AS table_position, CASE event_type WHEN 'signup' THEN '-' || k END AS zero_position, CASE event_type WHEN 'purchase' THEN '0.45' END AS vertical_position FROM s""")
def parse_event_lines(spark, d):
    ev = logs.parse_event_log(_event_lines(spark, d))
    pick = lambda k: F.try_element_at("payload", F.lit(k)).alias(k)
    return ev.select("source_file_id", "source_line", "ts", "ts_uncertainty", "layer", "phase", "event_type", "confidence", pick("table_position"), pick("zero_position"), pick("vertical_position"))


@query(f"WITH {a.EV} SELECT CAST(user_id AS VARCHAR) AS source_file_id, 'warning' AS severity, 'missing_timestamps' AS code, count(*) AS count FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def missing_stamps(spark, d):
    return logs.missing_stamp_diagnostics(logs.parse_event_log(_event_lines(spark, d)))


@query(f"""WITH {_RN}, c AS (SELECT *, lag(event_type) OVER w AS pe, lag(k // 50) OVER w AS pk FROM rn WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
k0 AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY rn) AS t0 FROM c WHERE rn = 1 OR pe <> event_type OR pk <> k // 50)
SELECT source_file_id, rn + 1 AS source_line, {ts("date_trunc('second', t0)")} AS ts_start, {ts("date_trunc('second', ts)")} AS ts_end,
  CASE WHEN pe <> event_type AND pk <> k // 50 THEN 'State,Heating' WHEN pe <> event_type THEN 'State' ELSE 'Heating' END AS changed_columns, CASE WHEN pe <> event_type THEN 'automation' ELSE 'heating' END AS subsystem FROM k0 WHERE rn > 1""")
def parse_state_lines(spark, d):
    text = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"), F.concat(F.floor(F.col("k") / 50).cast("string"), F.when(F.col("value") > 50, F.lit(".0")).otherwise(F.lit(""))))
    t = logs.parse_state_log(_lines(spark, d, text, "Timestamp;State;Heating"))
    return t.select("source_file_id", "source_line", "ts_start", "ts_end", "changed_columns", "subsystem")


@query(f"""WITH {_RN} SELECT source_file_id, rn AS source_line, {ts("date_trunc('second', ts)")} AS ts, 'low_trust_error_entry' AS event_type, 'warning' AS severity, {num('0.5')} AS confidence FROM rn""")
def parse_error_lines(spark, d):
    text = F.concat(F.date_format("ts", "dd.MM.yyyy HH:mm:ss"), F.lit(" fault "), F.col("k").cast("string"))
    return logs.parse_error_log(_lines(spark, d, text)).select("source_file_id", "source_line", "ts", "event_type", "severity", "confidence")


@query(f"""WITH {a.EV} SELECT event_id, CASE event_type WHEN 'signup' THEN 'gas_consumption_recorded' WHEN 'click' THEN 'powder_consumption_recorded' WHEN 'view' THEN 'restart_attempt' WHEN 'purchase' THEN 'filter_replaced' ELSE 'visual_defect_found' END AS event_type,
  CASE event_type WHEN 'signup' THEN CAST(k AS VARCHAR) WHEN 'click' THEN '0.5' END AS value, CASE event_type WHEN 'signup' THEN 'bar' WHEN 'click' THEN 'kg' END AS unit, CASE event_type WHEN 'signup' THEN 'A' || k END AS gas_cylinder_id,
  CASE event_type WHEN 'click' THEN 'batch' || k END AS powder_batch, CASE event_type WHEN 'click' THEN '316L' END AS material, {big("CASE event_type WHEN 'view' THEN k END")} AS layer, CASE event_type WHEN 'purchase' THEN 'filter' END AS component,
  CASE event_type WHEN 'signup' THEN 'consumed' WHEN 'view' THEN 'manual_restart' WHEN 'purchase' THEN 'filter_replaced' WHEN 'error' THEN 'porosity_observed' END AS action,
  {num("CASE event_type WHEN 'signup' THEN 0.95 WHEN 'click' THEN 1.1 WHEN 'view' THEN 0.65 WHEN 'purchase' THEN 0.7 ELSE 0.75 END")} AS confidence,
  CASE WHEN event_type IN ('signup', 'click', 'error') THEN 'draft' ELSE 'unverified' END AS verification_status FROM ev""")
def parse_operator_text(spark, d):
    k = F.col("k").cast("string")
    text = _by_type(
        signup=F.concat(F.lit("Баллон A"), k, F.lit(" потрачено "), k, F.lit(" бар")), click=F.concat(F.lit("Порошок batch"), k, F.lit(", 316L: 500 грамм")),
        view=F.concat(F.lit("Рестарт на слое "), k), purchase=F.lit("Фильтр заменён"), error=F.lit("видны поры"))
    msgs = a.events(spark, d).select("event_id", text.alias("text"))
    return parse_messages(msgs).select("event_id", "event_type", "value", "unit", "gas_cylinder_id", "powder_batch", "material", "layer", "component", "action", "confidence", "verification_status")


def _topic_sql(col: str) -> str:
    hit = lambda p: f"regexp_matches({col}, '(?i){p}')"
    return f"""CASE WHEN {hit('баллон|argon|аргон|газ')} THEN CASE WHEN {hit('(?:остаток|осталось|ост[.]?)[ \\t\\n]*[:=]?[ \\t\\n]*[0-9]')} OR {hit('(?:потрач|израсход|использов|расход|потрачено)[ \\t\\n]*[:=]?[ \\t\\n]*[0-9]')} THEN 'gas_consumption_recorded'
    WHEN {hit('нов|замен|постав')} THEN 'gas_cylinder_replaced' ELSE 'gas_pressure_issue' END
  WHEN {hit('порош|powder')} THEN CASE WHEN {hit('(?:потрач|израсход|использов|расход|потрачено)[ \\t\\n]*[:=]?[ \\t\\n]*[0-9]')} OR {hit('[0-9][ \\t\\n]*(?:кг|kg|грамм|g)')} THEN 'powder_consumption_recorded' WHEN {hit('сито|просе')} THEN 'powder_sieved' WHEN {hit('суш')} THEN 'powder_dried'
    WHEN {hit('цикл|reuse|повтор')} THEN 'powder_reused' ELSE 'powder_batch_changed' END
  WHEN {hit('уплотн')} THEN 'seal_replaced' WHEN {hit('фильтр|filter')} THEN 'filter_replaced' WHEN {hit('оптик')} THEN 'optics_cleaned' WHEN {hit('камер')} THEN 'chamber_cleaned' WHEN {hit('рекот')} THEN 'recoater_adjusted' WHEN {hit('калибр')} THEN 'calibration_performed'
  WHEN {hit('рестарт|restart')} THEN 'restart_attempt' WHEN {hit('принята|accepted|годн')} THEN 'part_accepted' WHEN {hit('забрак|rejected')} THEN 'part_rejected' WHEN {hit('дефект|пор')} THEN 'visual_defect_found' ELSE 'operator_observation' END"""


@query(f"SELECT {_topic_sql('text')} AS event_type, role, count(*) AS n FROM conversations GROUP BY 1, 2")
def conversation_topics(spark, d):
    return parse_messages(a.table(spark, d, "conversations").select("role", "text")).groupBy("event_type", "role").agg(F.count(F.lit(1)).alias("n"))


def _doc_lines(spark, d):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("source_file_id"), "text")
    return files.lines_of_content(docs)


_DL = """dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents),
ln AS (SELECT doc_id, line_no, rtrim(line, chr(13)) AS line FROM dl WHERE NOT (line = '' AND line_no = n))"""


@query(f"WITH {_DL} SELECT doc_id AS source_file_id, count(*) AS lines, {big('max(line_no)')} AS last_line, {big('sum(length(line))')} AS chars FROM ln GROUP BY 1")
def document_lines(spark, d):
    return _doc_lines(spark, d).groupBy("source_file_id").agg(F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("chars"))


def _phrase_sql() -> str:
    """The phrase table for a case-insensitive RE2 engine (ASCII digits and blanks, as in the given texts)."""
    out = []
    for words, every, pattern, kind, _ in EVENT_PHRASES:
        parts = [pattern.replace("(?iu)", "")] if pattern else (words if every else ["|".join(words)])
        out.append("WHEN " + " AND ".join(f"regexp_matches(line, '(?i){p}')" for p in parts) + f" THEN '{kind}'")
    return "CASE " + " ".join(out) + " ELSE 'log_message' END"


@query(f"WITH {_DL} SELECT {_phrase_sql()} AS event_type, count(*) AS n FROM ln WHERE trim(line) <> '' GROUP BY 1")
def document_phrases(spark, d):
    kinds = _doc_lines(spark, d).where(F.trim("line") != "").select(event_kind(F.col("line"))["event_type"].alias("event_type"))
    return kinds.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS checksum, strlen(text) AS size_bytes, 'ok' AS quality_status, 'utf-8' AS encoding FROM documents")
def content_inspection(spark, d):
    body = F.col("text").cast("binary")
    status = F.when(F.octet_length(body) == 0, "zero_byte").when(looks_binary(body), "binary_or_unknown").otherwise("ok")
    return a.table(spark, d, "documents").select("doc_id", F.sha2(body, 256).alias("checksum"), F.octet_length(body).cast("long").alias("size_bytes"), status.alias("quality_status"), guess_encoding(body).alias("encoding"))
