"""Delimited table logs: generic scan, sensor readings, burn and temperature tables.

Input everywhere is a line table (source_file_id, line_no, line). Cells stay in arrays next to their line,
so a table of any width is one narrow pass after the per-file header is joined in.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.logtext import fit_width, header_names, is_header, positional_names, split_cells
from laminaflow.functions.scalars import to_number
from laminaflow.model import SIGNAL_GROUPS
from laminaflow.operators.ordered import Series


def _headers(cells: DataFrame) -> DataFrame:
    """First non-blank line of each file: header flag, names, width."""
    first = cells.groupBy("source_file_id").agg(
        F.min("line_no").alias("_first"), F.min_by("_cells", "line_no").alias("_head"))
    named = is_header(F.col("_head"))
    return first.select(
        "source_file_id", F.when(named, F.col("_first")).alias("_header_line"),
        F.when(named, header_names(F.col("_head"))).otherwise(positional_names(F.col("_head"))).alias("header"))


def parse_table(lines: DataFrame) -> DataFrame:
    """Every non-header line with its file's header, fitted cells and the row flags.

    Columns: source_file_id, line_no, line, header, cells, malformed, repeated_header.
    """
    cells = lines.where(F.trim("line") != "").withColumn("_cells", split_cells(F.col("line")))
    df = cells.join(_headers(cells), "source_file_id")
    df = df.where("_header_line is null or line_no > _header_line")
    trimmed = F.transform("_cells", lambda c: F.trim(c))
    repeated = trimmed == F.col("header")
    width = F.size("header")
    return df.select(
        "source_file_id", "line_no", "line", "header", repeated.alias("repeated_header"),
        (~repeated & (F.size("_cells") != width)).alias("malformed"),
        F.size("_cells").alias("found_width"),
        fit_width(F.col("_cells"), width).alias("cells"))


def data_rows(table: DataFrame) -> DataFrame:
    return table.where("not repeated_header")


def table_summary(table: DataFrame, known_columns: Iterable[str] = ()) -> DataFrame:
    """Per file: rows, malformed rows, repeated headers, unknown columns."""
    known = F.array(*[F.lit(c) for c in known_columns]).cast("array<string>")
    return table.groupBy("source_file_id").agg(
        F.count_if(~F.col("repeated_header")).alias("total_rows"),
        F.count_if("malformed").alias("malformed_rows"),
        F.count_if("repeated_header").alias("repeated_headers"),
        F.array_except(F.first("header"), known).alias("unknown_columns"))


def table_diagnostics(table: DataFrame) -> DataFrame:
    """One warning per malformed row."""
    return table.where("malformed").select(
        "source_file_id", F.col("line_no").alias("source_line"), F.lit("warning").alias("severity"),
        F.lit("malformed_row").alias("code"),
        F.format_string("Expected %d columns, found %d.", F.size("header"), "found_width").alias("message"),
        F.substring("line", 1, 300).alias("context"))


def table_sample(table: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` data rows of every file."""
    return Series(data_rows(table), ["source_file_id"], ["line_no"]).with_row_number("row_no").frame.where(
        F.col("row_no") <= limit)


def table_cells(table: DataFrame) -> DataFrame:
    """Long form: one row per cell with the number read from it, or the text kept as it is."""
    zipped = F.arrays_zip(F.col("header").alias("column"), F.col("cells").alias("cell"))
    out = data_rows(table).select("source_file_id", "line_no", F.posexplode(zipped).alias("position", "_z"))
    text = F.nullif(F.trim("_z.cell"), F.lit(""))
    return out.select("source_file_id", "line_no", "position", F.col("_z.column").alias("column"),
                      to_number(text).alias("number"), text.alias("text"))


def sensor_readings(lines: DataFrame, signals: Iterable[str] = tuple(SIGNAL_GROUPS)) -> DataFrame:
    """Long readings of the known signals of pipe-separated sensor logs.

    Only the cells of wanted signals are exploded, so a 60-column log costs as much as its 9 known signals.
    """
    wanted = F.array(*[F.lit(s) for s in signals])
    head = lines.groupBy("source_file_id").agg(F.min("line_no").alias("_first"),
                                               F.min_by("line", "line_no").alias("_head"))
    names = F.transform(F.split("_head", r"\|", -1), lambda c: F.trim(c))
    head = head.select("source_file_id", "_first", F.filter(
        F.transform(names, lambda c, i: F.struct(c.alias("signal"), i.alias("at"))),
        lambda s: F.array_contains(wanted, s["signal"])).alias("_map"))
    rows = lines.join(head, "source_file_id").where("line_no > _first")
    rows = rows.select("source_file_id", "line_no", F.split("line", r"\|", -1).alias("_cells"),
                       F.explode("_map").alias("_m"))
    value = to_number(F.get("_cells", F.col("_m.at")))
    return rows.select("source_file_id", (F.col("line_no") - 1).alias("idx"),
                       F.col("_m.signal").alias("signal"), value.alias("value")).where("value is not null")


def startup_garbage(table: DataFrame, window_rows: int = 100, limit: float = 1e6) -> DataFrame:
    """Rows among the first ``window_rows`` of a file that hold an absurd value."""
    head = table_sample(table, window_rows)
    absurd = F.exists("cells", lambda c: F.coalesce(F.abs(to_number(c)) > limit, F.lit(False)))
    return head.groupBy("source_file_id").agg(F.count_if(absurd).alias("startup_bad_rows"))


def best_table(summaries: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Per session the table that covers most wanted columns (ties: lowest order)."""
    names = F.array(*[F.lit(w) for w in wanted])
    scored = summaries.withColumn("score", F.size(F.array_intersect("columns", names))).where("score > 0")
    best = F.max_by(F.struct("source_file_id", "score"), F.struct("score", -F.col("file_order")))
    return scored.groupBy("session_id").agg(best.alias("_b")).select("session_id", "_b.*")


def unknown_fields(table: DataFrame, family: str, known_columns: Iterable[str], top: int = 20,
                   examples: int = 5) -> DataFrame:
    """Report per unknown column: occurrences, most frequent values, first examples, meaning by prefix."""
    known = list(known_columns)
    cells = table_cells(table).where(~F.col("column").isin(known)) if known else table_cells(table)
    return unknown_field_report(cells.select(
        "column", F.lit(family).alias("family"), F.coalesce("text", F.lit("None")).alias("value"),
        "source_file_id", "line_no"), ["source_file_id", "line_no"], top, examples)


def unknown_field_report(cells: DataFrame, order: list[str], top: int = 20, examples: int = 5) -> DataFrame:
    """Same report over any (column, family, value) table; ``order`` says which examples come first."""
    key = ["column", "family"]
    counts = cells.groupBy(*key, "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    # equal counts rank in order of first appearance; negated so that the kernel's ascending order fits
    ranked = Series(counts.withColumn("_neg", -F.col("n")), key, ["_neg", "_first", "value"])
    ranked = ranked.with_row_number("rank").frame
    spread = ranked.where(F.col("rank") <= top).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("value_distribution"))
    shown = Series(cells.select(*key, "value", *order), key, [*order, "value"]).with_row_number("rank").frame
    shown = shown.where(F.col("rank") <= examples).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("examples"))
    total = counts.groupBy(*key).agg(F.sum("n").alias("occurrence_count"))
    return total.join(spread, key).join(shown, key).select(
        *key, "occurrence_count", "value_distribution", "examples",
        semantic_guess(F.col("column")).alias("candidate_semantic_class"), F.lit(0.25).alias("confidence"))


def semantic_guess(column):
    # Column prefix -> candidate meaning.
    guesses = [("SO", "oxygen_or_gas_candidate"), ("ST", "temperature_or_status_candidate"),
               ("SP", "pressure_candidate"), ("SF", "flow_or_filter_candidate"), ("BI", "binary_input_candidate")]
    out = F.lit("unknown")
    for prefix, meaning in reversed(guesses):
        out = F.when(F.upper(column).startswith(prefix), meaning).otherwise(out)
    return out
