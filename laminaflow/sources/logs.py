"""Event, monitor, timing, state and error logs: line tables in, event / transition tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.logtext import (
    CLOCK_STAMP, DAY_FIRST_STAMP, ISO_STAMP, event_kind, event_layer, event_payload, fit_width,
    header_names, positional_names, split_cells, stamp)
from laminaflow.functions.scalars import first_match, matched, seconds_between, to_number
from laminaflow.model import SUBSYSTEM_PREFIXES
from laminaflow.operators.ordered import Series


def _text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _located(lines: DataFrame) -> list:
    offset = F.col("offset") if "offset" in lines.columns else F.lit(None).cast("long")
    return ["source_file_id", F.col("line_no").alias("source_line"), offset.alias("source_offset")]


def line_hash(line: Column) -> Column:
    """Digest of the whole line, which excerpts of equal beginning don't share."""
    return F.sha2(line, 256).alias("line_sha")


def _day(lines: DataFrame) -> Column:
    return F.col("day") if "day" in lines.columns else F.lit(None).cast("date")


def midnight_rollover(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Adds a day each time the clock falls more than 12 h behind the previous stamp.

    Comparing raw stamps is enough: both sides of the comparison carry the same day shift.
    """
    s = Series(df, keys, order).with_last_before(_before=ts)
    fell = F.col(ts).isNotNull() & F.coalesce(
        F.col(ts) + F.expr("interval 12 hours") < F.col("_before"), F.lit(False))
    s = s.with_column("_fell", fell.cast("long")).with_running_sum("_days", F.col("_fell"))
    out = s.frame.withColumn(ts, F.timestamp_micros(
        F.unix_micros(ts) + F.col("_days") * F.lit(86_400_000_000)))
    return out.drop("_before", "_fell", "_days")


def parse_event_log(lines: DataFrame) -> DataFrame:
    """Main event log -> events, clocks carried over midnight in file order."""
    df = lines.where(F.trim("line") != "").select(
        "*", stamp(F.col("line"), _day(lines)).alias("_s"), event_kind(F.col("line")).alias("_k"))
    df = df.select(
        *_located(lines), F.substring("line", 1, 500).alias("raw_excerpt"), line_hash(F.col("line")), F.col("_s.ts").alias("ts"),
        F.col("_s.raw").alias("raw_timestamp"), F.col("_s.uncertainty").alias("ts_uncertainty"),
        event_layer(F.col("line"), F.col("_k.event_type")).alias("layer"),
        F.lit("operator_panel").alias("subsystem"), F.col("_k.phase").alias("phase"),
        F.col("_k.event_type").alias("event_type"), F.lit("info").alias("severity"),
        F.when(F.col("_s.ts").isNull(), 0.75).otherwise(0.95).alias("confidence"),
        event_payload(F.col("line"), F.col("_k.event_type")).alias("payload"))
    return midnight_rollover(df, ["source_file_id"], ["source_line"])


def missing_stamp_diagnostics(events: DataFrame) -> DataFrame:
    """Per file the number of events without a readable stamp."""
    return events.where("ts is null").groupBy("source_file_id").agg(
        F.count(F.lit(1)).alias("count")).select(
        "source_file_id", F.lit("warning").alias("severity"), F.lit("missing_timestamps").alias("code"), "count")


# Monitor entry marker -> event type; older firmware writes CODE=value pairs.
MONITOR_ENTRY = r"(?s)\|([RSPT])\|(.+)"
MONITOR_TYPES = {"R": "monitor_reading", "S": "monitor_state_change", "P": "monitor_print_params",
                 "T": "monitor_track_params"}
MONITOR_PAIR = r"(?U)([A-Za-zА-Яа-я_]*\d{1,4})\s*[:=]\s*([-+.\wА-Яа-я]+)"


def split_glued(line: Column) -> Column:
    """Entries of a line; a line with several stamps is cut in front of each."""
    def cut(pattern: str, guard: str = "") -> Column:
        head = F.regexp_replace(line, f"^.*?({guard}{pattern})", "$1")
        parts = F.split(head, f"(?={guard}{pattern})")
        parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
        return F.when(F.regexp_count(line, F.lit(pattern)) > 1, parts)
    # the guards stop a look-ahead from matching again inside the digits of the same stamp
    return F.coalesce(cut(ISO_STAMP), cut(DAY_FIRST_STAMP), cut(CLOCK_STAMP), F.array(line))


def parse_monitor_log(lines: DataFrame, subsystem: str = "monitor100") -> DataFrame:
    """Monitor log -> events, glued entries recovered."""
    df = lines.select("*", F.posexplode(split_glued(F.col("line"))).alias("entry_no", "entry"))
    df = df.withColumn("_s", stamp(F.col("entry"), _day(lines)))
    # the entry without its own stamp: digits of the stamp must not read as a CODE:value pair
    at, rest = F.instr("entry", F.col("_s.raw")), F.col("entry")
    body = F.coalesce(F.concat(F.substring(rest, F.lit(1), at - 1),
                               F.substring(rest, at + F.length("_s.raw"), F.length(rest))), rest)
    df = df.withColumn("_body", body)
    body = F.col("_body")
    code = matched(body, MONITOR_ENTRY)
    values = F.transform(F.split(F.rtrim(F.regexp_extract(body, MONITOR_ENTRY, 2), F.lit("|")), r"\|", -1),
                         lambda v: F.trim(v))
    df = df.select("*", code.alias("_code"), F.when(code.isNotNull(), values).alias("values"),
                   matched(body, MONITOR_PAIR, 1).alias("_pair"), matched(body, MONITOR_PAIR, 2).alias("_value"))
    legacy = F.col("_code").isNull()
    event_type = F.when(legacy & F.col("_pair").isNotNull(), F.concat(F.lit("monitor_code:"), "_pair")).otherwise(
        first_match([(F.col("_code") == k, v) for k, v in MONITOR_TYPES.items()], "monitor_transition"))
    state, n = F.col("_code") == "S", F.size("values")
    facts = {
        "raw_text": F.col("entry"),
        "code": F.when(legacy, F.col("_pair")), "value": F.when(legacy, F.col("_value")),
        "signal_id": F.when(state & (n >= 2), F.get("values", F.lit(0))),
        "signal_value": F.when(state & (n >= 2), F.get("values", F.lit(1))),
        "signal_name": F.when(state & (n >= 3), F.get("values", F.lit(2))),
        "values": F.when(F.col("_code").isin("R", "P", "T"), F.concat_ws("|", "values")),
    }
    packed = F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]),
                          lambda k, v: v.isNotNull())
    return df.select(
        *_located(lines), F.col("entry_no").cast("int").alias("entry_no"),
        F.substring("entry", 1, 500).alias("raw_excerpt"), line_hash(F.col("entry")), F.col("_s.ts").alias("ts"),
        F.col("_s.raw").alias("raw_timestamp"), F.col("_s.uncertainty").alias("ts_uncertainty"),
        F.lit(None).cast("int").alias("layer"), F.lit(subsystem).alias("subsystem"), _text("phase"),
        event_type.alias("event_type"), F.lit("info").alias("severity"),
        F.when(F.col("_s.ts").isNotNull(), 0.9).otherwise(0.65).alias("confidence"), packed.alias("payload"))


def monitor_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("source_file_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


# Layer timing formats and the meaning of their keys.
OLD_STATS = r"OLD_STATS:\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)"
NEW_STATS = r"NEW_STATS:\s*L(\d+)_detailed\|(.+)"
TIMING_KEYS = {"Pour_Start": "pour_start", "Pour_End": "pour_end", "Burn_Start": "burn_start",
               "Burn_End": "burn_end", "Layer_End": "layer_end", "MakeLayer_Start": "make_layer_start"}


def parse_timing_log(lines: DataFrame) -> DataFrame:
    """Layer timing log -> one summary event per OLD_STATS line, one event per NEW_STATS key."""
    line = F.col("line")
    # an OLD_STATS line never yields detail events, even when it is malformed
    old = lines.where(F.contains("line", F.lit("OLD_STATS:")) & line.rlike(OLD_STATS))
    summary = old.select(
        *_located(lines), F.lit(0).alias("entry_no"), F.substring("line", 1, 300).alias("raw_excerpt"), line_hash(F.col("line")),
        matched(line, OLD_STATS, 1).try_cast("int").alias("layer"), F.lit("layer").alias("phase"),
        F.lit("layer_timing_summary").alias("event_type"), F.lit(0.95).alias("confidence"),
        matched(line, OLD_STATS, 2).try_cast("long").alias("pour_ms"),
        matched(line, OLD_STATS, 3).try_cast("long").alias("burn_ms"),
        matched(line, OLD_STATS, 4).try_cast("long").alias("make_layer_ms"),
        F.lit(None).cast("long").alias("abs_ms"), _text("key"))
    tail = F.regexp_extract(line, NEW_STATS, 2)
    pair = lambda g: F.regexp_extract_all(tail, F.lit(r"(\w+):(\d+)"), F.lit(g))
    new = lines.where(~F.contains("line", F.lit("OLD_STATS:")) & line.rlike(NEW_STATS)).select(
        "*", F.posexplode(F.arrays_zip(pair(1).alias("key"), pair(2).alias("ms"))).alias("entry_no", "_p"))
    event_type = F.coalesce(
        first_match([(F.col("_p.key") == k, v) for k, v in TIMING_KEYS.items()]),
        F.concat(F.lit("time_"), F.lower("_p.key")))
    phase = first_match([(F.contains(event_type, F.lit(p)), p) for p in ("burn", "pour")], "layer")
    detail = new.select(
        *_located(lines), "entry_no", F.substring("line", 1, 300).alias("raw_excerpt"), line_hash(F.col("line")),
        matched(line, NEW_STATS, 1).try_cast("int").alias("layer"), phase.alias("phase"),
        event_type.alias("event_type"), F.lit(0.9).alias("confidence"),
        *[F.lit(None).cast("long").alias(c) for c in ("pour_ms", "burn_ms", "make_layer_ms")],
        F.col("_p.ms").try_cast("long").alias("abs_ms"), F.col("_p.key").alias("key"))
    return summary.unionByName(detail).withColumn("subsystem", F.lit("layer_timing"))


def timing_malformed(lines: DataFrame) -> DataFrame:
    """Per file the OLD_STATS / NEW_STATS lines that could not be read."""
    line = F.col("line")
    old, new = F.contains(line, F.lit("OLD_STATS:")), F.contains(line, F.lit("NEW_STATS:"))
    empty = ~F.regexp_extract(line, NEW_STATS, 2).rlike(r"\w+:\d+")
    bad = first_match([(old, ~line.rlike(OLD_STATS)), (new, empty)], False)
    return lines.where(bad).groupBy("source_file_id").agg(F.count(F.lit(1)).alias("malformed"))


def _canonical(cell: Column) -> Column:
    """Text under which equal cell values compare equal (1, 1.0 and 01 are the same state)."""
    return F.coalesce(to_number(cell).cast("string"), F.nullif(F.trim(cell), F.lit("")))


def state_rows(lines: DataFrame) -> DataFrame:
    """State log lines with header, stamp and the comparable state array (time columns left out)."""
    rows = lines.where(F.trim("line") != "").withColumn("_cells", split_cells(F.col("line")))
    head = rows.groupBy("source_file_id").agg(F.min("line_no").alias("_first"),
                                              F.min_by("_cells", "line_no").alias("_head"))
    clock = lambda c: F.lower(c).rlike("time|date")
    named = F.exists("_head", clock)
    head = head.select("source_file_id", F.when(named, F.col("_first")).alias("_header_line"),
                       F.when(named, header_names(F.col("_head"))).otherwise(
                           positional_names(F.col("_head"))).alias("header"))
    rows = rows.join(head, "source_file_id").where("_header_line is null or line_no > _header_line")
    cells = fit_width(F.col("_cells"), F.size("header"))
    pairs = F.filter(F.arrays_zip(F.col("header").alias("column"), F.transform(cells, _canonical).alias("value")),
                     lambda p: ~clock(p["column"]))
    return rows.select(
        *_located(lines), stamp(F.col("line"), _day(lines))["ts"].alias("ts"),
        F.substring("line", 1, 500).alias("raw_excerpt"),
        (F.size("_cells") != F.size("header")).alias("malformed"),
        pairs["column"].alias("columns"), pairs["value"].alias("state"))


def subsystem_of(columns: Column) -> Column:
    """Subsystem of the first changed column whose name starts with a known prefix."""
    def known(c: Column) -> Column:
        return first_match([(F.lower(c).startswith(p.lower()), s) for p, s in SUBSYSTEM_PREFIXES])
    hits = F.filter(F.transform(columns, known), lambda s: s.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.when(F.size(columns) > 0, "stateflow"))


def state_transitions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Run-length compression: one row per change of the state array.

    ``rows`` has columns ``columns`` (names), ``state`` (values), ``ts`` and optionally source_offset and
    raw_excerpt. ts_start is the stamp of the row at which the previous state began.
    """
    extra = [c for c in ("source_offset", "raw_excerpt") if c in rows.columns]
    s = Series(rows, keys, order).with_prev(_prev="state", _prev_cols="columns")
    kept = s.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("state")))
    kept = kept.with_prev(ts_start="ts", **{f"_from_{c}": c for c in extra})
    df = kept.frame.where("_prev is not null")
    place = F.filter(F.sequence(F.lit(0), F.size("state") - 1),
                     lambda i: ~F.get("state", i).eqNullSafe(F.get("_prev", i)))
    df = df.withColumn("_at", place)
    changed = F.transform("_at", lambda i: F.get("columns", i))
    values = lambda arr: F.map_from_arrays(changed, F.transform("_at", lambda i: F.get(arr, i)))
    shown = {"source_offset": "source_offset_start", "raw_excerpt": "raw_excerpt_sample"}
    return df.select(
        *keys, *order, "ts_start", F.col("ts").alias("ts_end"),
        F.when(F.col("ts") < F.col("ts_start"), 0.0).otherwise(
            seconds_between(F.col("ts_start"), F.col("ts"))).alias("duration_sec"),
        changed.alias("changed_columns"), values("_prev").alias("previous_state"),
        values("state").alias("new_state"), subsystem_of(changed).alias("subsystem"),
        *[F.col(f"_from_{c}").alias(shown[c]) for c in extra],
        *([F.col("source_offset").alias("source_offset_end")] if "source_offset" in extra else []))


def parse_state_log(lines: DataFrame) -> DataFrame:
    return state_transitions(state_rows(lines), ["source_file_id"], ["source_line"])


def parse_error_log(lines: DataFrame) -> DataFrame:
    """Every non-blank line is a low-trust warning."""
    df = lines.where(F.trim("line") != "").withColumn("_s", stamp(F.col("line"), _day(lines)))
    return df.select(
        *_located(lines), F.substring("line", 1, 500).alias("raw_excerpt"), line_hash(F.col("line")), F.col("_s.ts").alias("ts"),
        F.col("_s.raw").alias("raw_timestamp"), F.col("_s.uncertainty").alias("ts_uncertainty"),
        F.lit(None).cast("int").alias("layer"), F.lit("error_log").alias("subsystem"), _text("phase"),
        F.lit("low_trust_error_entry").alias("event_type"), F.lit("warning").alias("severity"),
        F.lit(0.5).alias("confidence"),
        F.create_map(F.lit("raw_text"), F.col("line"), F.lit("low_trust_source"), F.lit("true")).alias("payload"))


def empty_file_diagnostics(files: DataFrame) -> DataFrame:
    """An empty error log says nothing about the machine: info diagnostic instead of events."""
    return files.where((F.col("family") == "error_log") & (F.col("size_bytes") == 0)).select(
        F.col("file_id").alias("source_file_id"), F.lit("info").alias("severity"),
        F.lit("empty_error_log_low_trust").alias("code"),
        F.lit("Empty error.log does not imply absence of machine problems.").alias("message"))


def opaque_state_data(files: DataFrame) -> DataFrame:
    """State-data files: metadata and a diagnostic, no content."""
    binary = F.col("quality_status") == "binary_or_unknown"
    return files.where((F.col("family") == "stateflowdata_log") & (F.col("size_bytes") > 0)).select(
        F.col("file_id").alias("source_file_id"), "size_bytes",
        F.when(binary, "binary_or_unknown").otherwise("text").alias("format"), "encoding",
        F.when(binary, "warning").otherwise("info").alias("severity"),
        F.when(binary, "unsupported_stateflow_data").otherwise("stateflow_data_text_preserved").alias("code"))
