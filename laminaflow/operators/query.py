"""Structured queries over named entities: a small spec turned into one DataFrame."""

from __future__ import annotations

import dataclasses
import warnings
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Session facts reachable through the stored JSON context.
CONTEXT_FIELDS = ["material", "powder_batch", "gas_cylinder_id", "duration_sec", "pause_count", "restart_attempt_count"]
CONTEXT_PATH = "$.runtime_payload.group.features."


@dataclasses.dataclass
class QuerySpec:
    entity: str
    action: str = "list"
    field: str | None = None
    filters: list[dict[str, Any]] = dataclasses.field(default_factory=list)
    group_by: str | None = None
    order_by: str | None = None
    order_dir: str = "asc"
    limit: int | None = None
    offset: int = 0
    select: list[str] = dataclasses.field(default_factory=list)


def column_of(df: DataFrame, name: str) -> Column | None:
    """A real column, or a session fact read from the JSON context column."""
    if name in df.columns:
        return F.col(name)
    if name in CONTEXT_FIELDS and "context" in df.columns:
        kind = df.schema["context"].dataType.simpleString()
        if kind == "string":
            return F.get_json_object("context", CONTEXT_PATH + name)
        return F.col(f"context.{name}")
    return None


def condition(df: DataFrame, spec: dict[str, Any], as_of: Column) -> Column | None:
    """One predicate; an unknown field or operator is reported and ignored."""
    op, value = spec["operator"], spec["value"]
    if op == "in_last_n":
        days = value * 7 if spec["field"] == "sessions" else value
        ts = "start_ts" if "start_ts" in df.columns else "timestamp"
        return F.col(ts) >= as_of - F.expr(f"interval {int(days)} days")
    col = column_of(df, spec["field"])
    if col is None:
        warnings.warn(f"unknown field {spec['field']!r} ignored")
        return None
    tests = {
        "eq": lambda: col == value, "gt": lambda: col > value, "gte": lambda: col >= value,
        "lt": lambda: col < value, "lte": lambda: col <= value,
        "between": lambda: col.between(value[0], value[1]), "in": lambda: col.isin(*value),
        "contains": lambda: F.contains(F.lower(col.cast("string")), F.lit(str(value).lower())),
    }
    if op not in tests:
        warnings.warn(f"unknown operator {op!r} ignored")
        return None
    return tests[op]()


def run_query(spec: QuerySpec, entities: dict[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """count, list, sum, avg, max, min or group_by over the filtered entity."""
    if spec.entity not in entities:
        raise ValueError(f"unknown entity: {spec.entity}")
    df = entities[spec.entity]
    as_of = F.current_timestamp() if as_of is None else as_of
    for f in spec.filters:
        cond = condition(df, f, as_of)
        if cond is not None:
            df = df.where(cond)
    if spec.action == "count":
        return df.agg(F.count(F.lit(1)).alias("result"))
    if spec.action in ("sum", "avg", "max", "min"):
        col = column_of(df, spec.field) if spec.field else None
        if col is None:
            raise ValueError(f"action {spec.action!r} needs a known field")
        if spec.action in ("sum", "avg"):
            col = col.try_cast("double")
        return df.agg(getattr(F, spec.action)(col).alias("result"))
    if spec.action == "group_by":
        col = column_of(df, spec.group_by) if spec.group_by else None
        if col is None:
            raise ValueError("group_by needs a known field")
        out = df.where(col.isNotNull()).groupBy(col.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        out = out.orderBy(F.desc("count"), "value")
        return out.limit(spec.limit) if spec.limit else out
    if spec.action != "list":
        raise ValueError(f"unknown action: {spec.action}")
    if spec.order_by:
        col = column_of(df, spec.order_by)
        if col is not None:
            tie = [F.col(c) for c in df.columns[:1] if c != spec.order_by]
            df = df.orderBy(col.desc() if spec.order_dir == "desc" else col.asc(), *tie)
    if spec.offset:
        df = df.offset(spec.offset)
    if spec.limit:
        df = df.limit(spec.limit)
    if not spec.select:
        return df
    picked = [(n, column_of(df, n)) for n in spec.select]
    return df.select(*[c.alias(n) for n, c in picked if c is not None])


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page in a total order (give a unique tie-breaker)."""
    return df.orderBy(*order).offset(skip).limit(limit)


def page_info(df: DataFrame, skip: int, limit: int) -> DataFrame:
    """Total and returned row counts that go with ``page``."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(0), F.least(F.lit(limit), total - skip)).alias("count"))


def iso(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, for hand-over."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if t.startswith("timestamp")
                       else F.col(c) for c, t in df.dtypes])


def search_records(records: DataFrame, name: str | None = None, material: str | None = None,
                   date_from: Any = None, date_to: Any = None) -> DataFrame:
    """Print archive search; the effective date is printed_at, else created_at."""
    df = records.withColumn("effective_date", F.coalesce("printed_at", "created_at"))
    if name:
        df = df.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if material:
        df = df.where(F.col("material") == material)
    if date_from is not None:
        df = df.where(F.col("effective_date") >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col("effective_date") <= F.lit(date_to))
    return df


def list_entity(df: DataFrame, where: Column | None = None, order: list[Column] | None = None,
                skip: int = 0, limit: int | None = None) -> DataFrame:
    """Generic filtered listing: per-session events, segments, transitions, diagnostics, pending messages."""
    out = df if where is None else df.where(where)
    out = out.orderBy(*order) if order else out
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit is not None else out


def telemetry_sessions(sessions: DataFrame) -> DataFrame:
    """Real prints that carry a time axis; the stored class wins over the column."""
    kind = F.coalesce("payload_classification", "classification")
    return sessions.where((kind == "REAL_PRINT") & (F.col("telemetry_points") > 0))
