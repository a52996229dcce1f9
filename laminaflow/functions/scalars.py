"""Column helpers shared by every layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def finite_or_null(df: DataFrame) -> DataFrame:
    """Non-finite doubles become null in every floating column."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.when(finite(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float")
        else F.col(f"`{c}`") for c in df.columns])


def to_number(col: Column) -> Column:
    """Number in a log cell (comma or point as decimal mark), null when it is text."""
    return F.replace(F.trim(col), F.lit(","), F.lit(".")).try_cast("double")


def clock_seconds(col: Column) -> Column:
    """Seconds since midnight of an ``H:M:S[.fff]`` text, null when malformed."""
    parts = F.split(F.trim(col), ":")
    h, m = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + to_number(F.get(parts, F.lit(2))))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def grade(col: Column, good: float, fair: float, names: Sequence[str] = ("good", "fair", "poor")) -> Column:
    return F.when(col >= good, names[0]).when(col >= fair, names[1]).when(col.isNotNull(), names[2])


def stable_id(*cols: Column, prefix: str = "") -> Column:
    """Deterministic short id: first 16 hex digits of the SHA-256 of the '|'-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16))


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first true condition."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def matched(col: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null instead of the empty string when nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def even_pick(idx: Column, n: Column, limit: int, step_first: bool = True) -> Column:
    """True when 0-based ``idx`` is one of ``limit`` evenly spread positions of ``n`` rows.

    Positions are round-half-even(i*(n-1)/(limit-1)); at most two ``i`` can land on a given row.
    """
    if limit < 2:
        return idx == 0
    ratio = (n - 1) / F.lit(float(limit - 1))
    near = idx / ratio
    def lands(i: Column) -> Column:
        at = i * ratio if step_first else i * (n - 1) / F.lit(float(limit - 1))
        return (i >= 0) & (i <= limit - 1) & (F.rint(at) == idx)
    return (n <= limit) | lands(F.floor(near)) | lands(F.ceil(near))
