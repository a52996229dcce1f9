"""Extension points: parser per file family, machine profile as dimension tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow import model
from laminaflow.sources import logs, tables

Parser = Callable[[DataFrame], DataFrame]


@dataclass
class Profile:
    """What a machine type contributes: its signals, chart limits and consumables, all as small tables."""

    profile_id: str
    version: str
    signals: Callable[[SparkSession], DataFrame] = model.signal_dimension
    thresholds: Callable[[SparkSession], DataFrame] = model.chart_thresholds
    consumables: Callable[[SparkSession], DataFrame] = model.consumable_dimension
    parsers: dict[str, Parser] = field(default_factory=dict)


class ParserRegistry:
    """family -> function of a line table. Unknown families and empty files become diagnostics, not errors."""

    def __init__(self) -> None:
        self._parsers: dict[str, Parser] = {}

    def register(self, family: str, parser: Parser) -> None:
        self._parsers[family] = parser

    def get(self, family: str) -> Parser | None:
        return self._parsers.get(family)

    def families(self) -> list[str]:
        return sorted(self._parsers)

    def parse(self, lines: DataFrame) -> dict[str, DataFrame]:
        """One result per registered family. ``lines`` carries ``family``.

        Bad cells never fail a job (every cast is a try_cast); a parser that cannot even be planned is reported
        by ``diagnose`` instead of stopping the other families.
        """
        out = {}
        for family, parser in self._parsers.items():
            try:
                out[family] = parser(lines.where(F.col("family") == family))
            except Exception as exc:  # one bad parser must not stop the batch
                out[family] = lines.where(F.col("family") == family).select("source_file_id").distinct().select(
                    "source_file_id", F.lit("error").alias("severity"), F.lit("parser_exception").alias("code"),
                    F.lit(str(exc)).alias("message"))
        return out

    def diagnose(self, files: DataFrame) -> DataFrame:
        """Warning per file whose family has no parser, info per empty file."""
        known = F.col("family").isin(*self._parsers) if self._parsers else F.lit(False)
        code = F.when(~known, "unsupported_file_family").when(F.col("size_bytes") == 0, "zero_byte")
        return files.withColumn("code", code).where("code is not null").select(
            F.col("file_id").alias("source_file_id"),
            F.when(F.col("code") == "zero_byte", "info").otherwise("warning").alias("severity"), "code",
            F.concat(F.lit("No events read from family "), "family").alias("message"))


def default_registry() -> ParserRegistry:
    reg = ParserRegistry()
    reg.register("main_event_log", logs.parse_event_log)
    reg.register("monitor100_log", logs.parse_monitor_log)
    reg.register("monitor200_log", lambda lines: logs.parse_monitor_log(lines, "monitor100"))
    reg.register("time_log", logs.parse_timing_log)
    reg.register("stateflow_log", logs.parse_state_log)
    reg.register("error_log", logs.parse_error_log)
    for family in ("sensors_log", "burn_log", "table_temp_log"):
        reg.register(family, tables.parse_table)
    return reg
