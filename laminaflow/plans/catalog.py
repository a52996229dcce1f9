"""Registry of named queries with, where SQL can say it, the equivalent SQL for a side-by-side check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Two engines differ in the last bits of a double. A shift far below the kept six digits moves values that are exact
# decimal ties (averages of cents, say) off the rounding boundary, so both sides round them the same way.
TIE_SHIFT = "0.00000000037"


def edge(df: DataFrame) -> DataFrame:
    """Plain result columns: longs, doubles rounded to 6 digits, text (time stamps and arrays included)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c + F.lit(float(TIE_SHIFT)), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("date", "boolean"):
            c = c.cast("string")
        elif kind == "array<string>":
            c = F.concat_ws(",", c)
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, name: str | None = None):
    """Registers ``fn(spark, sf_dir) -> DataFrame`` under its name, with its SQL when there is one."""
    def wrap(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: edge(fn(prepare(spark), sf_dir))
        if sql is not None:
            SQL[key] = sql
        return fn
    return wrap


# SQL fragments shared by the equivalents
def num(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + CAST({TIE_SHIFT} AS DOUBLE), 6) + 0.0"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def ts(expr: str) -> str:
    return f"strftime(CAST({expr} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"
