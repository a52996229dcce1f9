"""Reading log text with column expressions: time stamps, encodings, cells, phrase rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laminaflow.functions.scalars import first_match, matched, to_number

# The three time-stamp layouts, most complete first.
ISO_STAMP = r"(\d{4})[-/.](\d{2})[-/.](\d{2})[ T_]+(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?"
DAY_FIRST_STAMP = r"(\d{2})[-/.](\d{2})[-/.](\d{4})[ T_]+(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?"
CLOCK_STAMP = r"(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?"
# The two date layouts accepted in file names.
NAME_DATE = r"(20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?([0-3]\d)"
NAME_DATE_DAY_FIRST = r"([0-3]\d)[-_.](0[1-9]|1[0-2])[-_.](20\d{2})"


def name_date(name: Column) -> Column:
    """Print day encoded in a file name."""
    def read(pattern: str, order: tuple[int, int, int]) -> Column:
        parts = [F.regexp_extract(name, pattern, g) for g in order]
        return F.concat_ws("-", *parts).try_cast("date")
    return F.when(name.rlike(NAME_DATE), read(NAME_DATE, (1, 2, 3))).otherwise(
        read(NAME_DATE_DAY_FIRST, (3, 2, 1)))


def stamp(line: Column, day: Column) -> Column:
    """Struct(ts, raw, uncertainty) of the first readable time stamp in ``line``.

    A bare clock needs ``day``; its uncertainty is one day because the day is only a hint.
    """
    # one scan of the line per layout; the parts are then cut out of the short token it found
    def token(pattern: str) -> Column:
        return F.regexp_extract(line, pattern, 0)
    def clock_text(raw: Column) -> Column:
        micros = F.rpad(F.substring(F.regexp_extract(raw, CLOCK_STAMP, 2), 1, 6), 6, "0")
        return F.concat(F.regexp_extract(raw, CLOCK_STAMP, 1), F.lit("."), micros)
    def dated(raw: Column, y: int, m: int, d: int) -> Column:
        parts = F.concat_ws("-", F.substring(raw, y, 4), F.substring(raw, m, 2), F.substring(raw, d, 2))
        return F.when(raw != "", F.concat(parts, F.lit(" "), clock_text(raw)).try_cast("timestamp"))
    clock = F.concat(day.cast("string"), F.lit(" "), clock_text(token(CLOCK_STAMP))).try_cast("timestamp")
    def found(ts: Column, pattern: str, doubt: float) -> Column:
        return F.when(ts.isNotNull(), F.struct(
            ts.alias("ts"), token(pattern).alias("raw"),
            F.lit(doubt).alias("uncertainty")))
    return F.coalesce(
        found(dated(token(ISO_STAMP), 1, 6, 9), ISO_STAMP, 0.0),
        found(dated(token(DAY_FIRST_STAMP), 7, 4, 1), DAY_FIRST_STAMP, 0.0),
        found(clock, CLOCK_STAMP, 86400.0),
        F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("raw"),
                 F.lit(0.0).alias("uncertainty")))


# Code page 1251 above ASCII, derived from Python's codec rather than typed out.
_LATIN = bytes(range(128, 256)).decode("latin-1")
_CYRILLIC = bytes(range(128, 256)).decode("cp1251", errors="replace")


def decode_cp1251(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), _LATIN, _CYRILLIC)


def decode_line(raw: Column, encoding: Column | None = None) -> Column:
    """Text of one line: UTF-8 when valid, code page 1251 otherwise or when the file says so."""
    utf8 = F.is_valid_utf8(raw)
    if encoding is not None:
        utf8 = utf8 & F.coalesce(~encoding.isin("cp1251", "latin-1"), F.lit(True))
    legacy = decode_cp1251(raw.cast("binary"))
    if encoding is not None:
        legacy = F.when(encoding == "latin-1", F.decode(raw.cast("binary"), "ISO-8859-1")).otherwise(legacy)
    return F.rtrim(F.when(utf8, F.ltrim(raw, F.lit("﻿"))).otherwise(legacy), F.lit("\r\n"))


def guess_encoding(content: Column) -> Column:
    """utf-8-sig / utf-8 / cp1251 / latin-1 from the whole content of a file."""
    return first_match([
        (F.octet_length(content) == 0, "utf-8"),
        (~F.is_valid_utf8(content.cast("string")) & ~F.contains(F.decode(content, "ISO-8859-1"), F.lit("\x98")), "cp1251"),
        (~F.is_valid_utf8(content.cast("string")), "latin-1"),
        (F.hex(F.substring(content, 1, 3)) == "EFBBBF", "utf-8-sig"),
    ], "utf-8")


def looks_binary(content: Column) -> Column:
    """A NUL byte, or under 70 % text bytes, anywhere in a file."""
    text = F.decode(content, "ISO-8859-1")
    odd = F.regexp_count(text, F.lit(r"[^\n\r\t\x08\f\x20-\x7E\x80-\xFF]"))
    return (F.octet_length(content) > 0) & (F.contains(text, F.lit("\x00")) | (10 * odd > 3 * F.octet_length(content)))


def _quoted_split(text: Column, delimiter: str) -> Column:
    """Delimited cells; delimiters inside double quotes do not split."""
    plain = F.split(text, delimiter, -1)
    careful = F.transform(
        F.split(text, delimiter + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1),
        lambda c: F.when(c.rlike(r'^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2),
                                                       F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(text, F.lit('"')), careful).otherwise(plain)


def split_cells(line: Column) -> Column:
    """Cells of a table row: pipe, semicolon, tab, comma (three cells or more), else blanks."""
    tight = F.trim(line)
    pipes = _quoted_split(tight, r"\|")
    pipes = F.when(F.trim(F.element_at(pipes, -1)) == "", F.slice(pipes, F.lit(1), F.size(pipes) - 1)).otherwise(pipes)
    return first_match([
        (F.contains(tight, F.lit("|")), pipes),
        (F.contains(line, F.lit(";")), _quoted_split(line, ";")),
        (F.contains(line, F.lit("\t")), _quoted_split(line, "\t")),
        (F.size(F.split(line, ",", -1)) > 2, _quoted_split(line, ",")),
    ], F.split(tight, r"\s+", -1))


def is_text_cell(cell: Column) -> Column:
    return (F.trim(cell) != "") & to_number(cell).isNull()


def is_header(cells: Column) -> Column:
    """At least half of the cells (and at least one) are words."""
    words = F.size(F.filter(cells, is_text_cell))
    return words >= F.greatest(F.lit(1), F.floor(F.size(cells) / 2))


def header_names(cells: Column) -> Column:
    return F.transform(cells, lambda c, i: F.coalesce(
        F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))


def positional_names(cells: Column) -> Column:
    return F.transform(cells, lambda c, i: F.concat(F.lit("col_"), i.cast("string")))


def fit_width(cells: Column, width: Column) -> Column:
    """Pad with empty cells or cut to ``width``."""
    pad = F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int"))
    return F.slice(F.concat(cells, pad), F.lit(1), width)


# Patterns of the main event log.
BURN_LINE = r"(?iu)(-?\d+)\s+(\d+)\s+Прожиг"
TABLE_POSITION = r"(?iu)текущая\s+позиция\s+стола\s*(-?\d+)"
LAYER_POUR = r"(?iu)Отсыпка\s+слоя\s+(c|без)\s+опуск"
ZERO_POSITION = r"(?iu)Старт\s+Ноль\s*=\s*(-?\d+)"
LAYER_MENTION = r"(?iu)(?:layer|слой)\s*[:=#-]?\s*(\d+)"
VERTICAL_POSITION = r"(?iu)(?:LIR|vertical|z|позици[яи])\s*[:= ]\s*([-+]?\d+(?:[.,]\d+)?)"

# Fixed values: (words, all needed?, pattern or None, event type, phase); the first phrase found decides. Words are
# looked up in the lower-cased line, which is cheap; a pattern only runs on lines that have a word.
EVENT_PHRASES = [
    (("ожидание", "прожиг"), True, None, "wait_for_burn", None),
    (("отсыпка",), True, LAYER_POUR, "layer_pour", "pour"),
    (("прожиг",), True, BURN_LINE, "burn_event", "burn"),
    (("старт прожига", "start burn"), False, None, "burn_start", "burn"),
    (("перемещение ракеля",), True, None, "recoater_move", None),
    (("старт",), True, ZERO_POSITION, "session_start", "init"),
    (("pause", "пауза", "останов"), False, None, "pause", "pause"),
    (("resume", "продолж", "возобнов"), False, None, "resume", "restart_attempts"),
    (("restart", "перезапуск", "рестарт"), False, None, "restart_attempt", "restart_attempts"),
    (("finish", "end", "заверш", "конец"), False, None, "finish", "finish"),
    (("burn", "спек", "плав", "прожиг"), False, None, "burn_event", "burn"),
    (("start", "старт", "начал"), False, None, "start", "init"),
    (("layer", "слой"), False, LAYER_MENTION, "layer_reference", None),
]


def event_kind(line: Column) -> Column:
    """Struct(event_type, phase) of an event-log line."""
    low = F.lower(line)
    def found(words, every, pattern) -> Column:
        cond = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            cond = (cond & F.contains(low, F.lit(w))) if every else (cond | F.contains(low, F.lit(w)))
        return cond if pattern is None else cond & line.rlike(pattern)
    return first_match(
        [(found(w, every, p), F.struct(F.lit(t).alias("event_type"), F.lit(ph).cast("string").alias("phase")))
         for w, every, p, t, ph in EVENT_PHRASES],
        F.struct(F.lit("log_message").alias("event_type"), F.lit(None).cast("string").alias("phase")))


def event_layer(line: Column, event_type: Column) -> Column:
    """Layer number: from the burn line itself, otherwise any layer mention."""
    burn = F.when((event_type == "burn_event") & line.rlike(BURN_LINE), matched(line, BURN_LINE, 2))
    return F.coalesce(burn, matched(line, LAYER_MENTION)).try_cast("int")


def event_payload(line: Column, event_type: Column) -> Column:
    """Extra facts of the line as a string map."""
    table = first_match([
        (event_type == "layer_pour", matched(line, TABLE_POSITION)),
        ((event_type == "burn_event") & line.rlike(BURN_LINE), matched(line, BURN_LINE, 1)),
    ])
    facts = {
        "raw_text": line,
        "with_descent": F.when(event_type == "layer_pour",
                               (F.lower(matched(line, LAYER_POUR)) == "c").cast("string")),
        "table_position": table,
        "zero_position": F.when(event_type == "session_start", matched(line, ZERO_POSITION)),
        "vertical_position": F.when(table.isNull(), to_number(matched(line, VERTICAL_POSITION)).cast("string")),
    }
    packed = F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)])
    return F.map_filter(packed, lambda k, v: v.isNotNull())
