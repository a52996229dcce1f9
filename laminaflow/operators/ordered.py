"""Ordered kernels that survive hot keys.

A window partitioned by session puts one whole session in one task. That is fine for the usual session and
fatal when one session owns a third of the readings, so every ordered operator goes through ``Series``:

* a key of n rows is cut into *chunks* by the value of its first order column, evenly between its least and
  greatest: one chunk up to ``spark.laminaflow.hotRows`` rows, ``CUTS`` for every further such number of rows;
* windows run inside (key, chunk), and what crosses a chunk border (row count, running total, last row) is
  carried by a table with one row per chunk, of keys with several chunks only.

All of this is one lazy plan: nothing is counted, written or collected while it is built. Where no key has more
than one chunk, the table of keys to cut is empty and adaptive execution drops the branches behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
#: Whether the row's key has several chunks.
CUT = "_cut"
HOT_ROWS = 4_000_000
#: Chunks for every HOT_ROWS rows of a key that has more of them, so that a burst in time is cut as well.
CUTS = 64


def hot_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.laminaflow.hotRows", str(HOT_ROWS)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; keeps the left copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordinal(col: Column, kind: T.DataType) -> Column:
    """A double that never falls while ``col`` rises; null for types that have no such number."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):  # the first six bytes as a number
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return F.nanvl(col.cast("double"), F.lit(float("inf")))
    return F.lit(None).cast("double")


def hot_keys(df: DataFrame, keys: Sequence[str], place: Column | None = None) -> DataFrame:
    """Keys with more than ``hot_limit`` rows: n, and the least and greatest ``place``.

    There are at most (rows / hot_limit) of them, some hundred thousand for the largest tables, so they may be broadcast.
    """
    span = [] if place is None else [F.min(place).alias("_low"), F.max(place).alias("_high")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *span).where(F.col("_rows") > hot_limit(df.sparkSession))


class Series:
    """Rows of ``df`` in ``order`` (ascending, nulls first) inside each key.

    Rows of one key that agree in the first order column stay in one chunk.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        place = ordinal(F.col(self.order[0]), df.schema[self.order[0]].dataType)
        hot = hot_keys(df, self.keys, F.when(F.abs(place) < float("inf"), place))
        marked = null_safe_join(df, F.broadcast(hot), self.keys)
        cuts = F.ceil(F.col("_rows") / hot_limit(df.sparkSession)) * CUTS
        share = F.try_divide(F.least(F.greatest(place, F.col("_low")), F.col("_high")) - F.col("_low"), F.col("_high") - F.col("_low"))
        chunk = F.when(F.col("_rows").isNull(), 0).when(place.isNull(), -1).otherwise(F.coalesce(F.floor(share * cuts), F.lit(0)))
        # missing places come first, infinite ones and NaN in the outer chunks
        marked = marked.withColumn(CHUNK, chunk.cast("long")).withColumn(CUT, F.col("_rows").isNotNull())
        self.df = self.base = marked.drop("_rows", "_low", "_high")

    def _with(self, df: DataFrame, base: DataFrame | None = None) -> "Series":
        other = object.__new__(Series)
        other.keys, other.order, other.df, other.base = self.keys, self.order, df, self.base if base is None else base
        return other

    @property
    def within(self) -> list[str]:
        return [*self.keys, CHUNK]

    @property
    def window(self):
        return Window.partitionBy(*self.within).orderBy(*[F.col(c).asc() for c in self.order])

    @property
    def frame(self) -> DataFrame:
        return self.df.drop(CHUNK, CUT)

    def select(self, *cols) -> "Series":
        out = self.df.select(*cols, CHUNK, CUT)
        return self._with(out, out)

    def where(self, condition: Column) -> "Series":
        """The rows that are left are what later steps carry."""
        out = self.df.where(condition)
        return self._with(out, out)

    def with_column(self, name: str, col: Column) -> "Series":
        out = self.df.withColumn(name, col)
        return self._with(out, self.base.withColumn(name, col) if self._plain(col) else out)

    def _plain(self, *cols: Column) -> bool:
        """Whether the rows as they came in are enough for ``cols``: no name that an earlier step added shows up in them."""
        added = set(self.df.columns).difference(self.base.columns)
        return not any(name in str(c) for name in added for c in cols)

    def _totals(self, *aggs: Column) -> DataFrame:
        """One row per chunk of keys with several; from the rows as they came in, if that is enough."""
        return (self.base if self._plain(*aggs) else self.df).where(CUT).groupBy(*self.within).agg(*aggs)

    def _carry(self, totals: DataFrame) -> DataFrame:
        return null_safe_join(self.df, totals, self.within)

    def _chunk_window(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def with_running_sums(self, sums: dict[str, Column]) -> "Series":
        """Inclusive running sums by name, all in one pass."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        base = self._totals(*[F.sum(c).alias(f"_s_t{i}") for i, c in enumerate(sums.values())])
        base = base.select(*self.within, *[F.sum(f"_s_t{i}").over(before).alias(f"_s_base{i}") for i in range(len(sums))])
        out = self._with(self.df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}))._carry(base)
        whole = {n: F.coalesce(F.col(n) + F.col(f"_s_base{i}"), F.col(n), F.col(f"_s_base{i}")) for i, n in enumerate(sums)}
        return self._with(out.withColumns(whole).drop(*[f"_s_base{i}" for i in range(len(sums))]))

    def with_running_sum(self, name: str, col: Column) -> "Series":
        """Inclusive running sum of ``col``."""
        return self.with_running_sums({name: col})

    def with_running_max(self, name: str, col: Column) -> "Series":
        """Inclusive running maximum of ``col``; nulls don't count."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        base = self._totals(F.max(col).alias("_s_t")).select(*self.within, F.max("_s_t").over(before).alias("_s_base"))
        out = self._with(self.df.withColumn(name, F.max(col).over(upto)))._carry(base)
        return self._with(out.withColumn(name, F.greatest(name, "_s_base")).drop("_s_base"))

    def with_row_number(self, name: str = "rn") -> "Series":
        """1-based position inside the key."""
        return self.with_running_sum(name, F.lit(1).cast("long"))

    def with_count(self, name: str = "n") -> "Series":
        total = self._totals(F.count(F.lit(1)).alias("_s_t")).select(*self.within, F.sum("_s_t").over(Window.partitionBy(*self.keys)).alias("_s_all"))
        local = self.df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*self.within)))
        out = self._with(local)._carry(total)
        return self._with(out.withColumn(name, F.coalesce("_s_all", name)).drop("_s_all"))

    def _neighbour(self, cols: dict[str, str], forward: bool) -> "Series":
        packed = F.struct(*[F.col(src).alias(dst) for dst, src in cols.items()])
        step = F.lead if forward else F.lag
        place = F.struct(*self.order)
        edges = self._totals((F.min_by if forward else F.max_by)(packed, place).alias("_s_e"))
        edges = edges.select(*self.within, step("_s_e").over(self._chunk_window()).alias("_s_edge"))
        df = self._with(self.df.withColumn("_s_near", step(packed).over(self.window)))._carry(edges)
        df = df.withColumn("_s_near", F.coalesce("_s_near", "_s_edge"))
        df = df.select(*[c for c in df.columns if c not in ("_s_near", "_s_edge")],
                       *[F.col(f"_s_near.{dst}").alias(dst) for dst in cols])
        return self._with(df)

    def with_prev(self, **cols: str) -> "Series":
        """``new=existing``: value of the previous row, null on the first."""
        return self._neighbour(cols, False)

    def with_next(self, **cols: str) -> "Series":
        """``new=existing``: value of the next row, null on the last."""
        return self._neighbour(cols, True)

    def with_last_before(self, **cols: str) -> "Series":
        """``new=existing``: latest non-null value strictly before the row, all columns in one pass."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct(*self.order)
        tail = self._totals(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_t_{n}") for n, c in cols.items()])
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        tail = tail.select(*self.within, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in cols])
        local = self.df.withColumns({n: F.last(c, ignorenulls=True).over(upto) for n, c in cols.items()})
        out = self._with(local)._carry(tail).withColumns({n: F.coalesce(n, f"_c_{n}") for n in cols})
        return self._with(out.drop(*[f"_c_{n}" for n in cols]))

    def with_previous_values(self, name: str, col: str, size: int) -> "Series":
        """Array with the up to ``size`` preceding values that are not null among the ``size`` preceding rows.

        The last ``size`` rows of the chunks before are carried, so the bounded frame never has to look outside its task.
        """
        value = F.struct(F.col(col).alias("v"))
        back = Window.partitionBy(*self.within).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        source = self.base if col in self.base.columns else self.df
        ends = source.where(CUT).withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= size)
        ends = ends.groupBy(*self.within).agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("b"), value.alias("s")))).alias("_tail"))
        # every chunk of a key has a row, so the ``size`` chunks before are enough
        nearby = self._chunk_window().rowsBetween(-size, -1)
        ends = ends.select(*self.within, F.transform(F.flatten(F.collect_list("_tail").over(nearby)), lambda x: x["s"]).alias("_tail"))
        local = self.df.withColumn("_own", F.collect_list(value).over(self.window.rowsBetween(-size, -1)))
        out = self._with(local)._carry(ends)
        missing = F.greatest(F.lit(0), F.least(F.lit(size) - F.size("_own"), F.size("_tail")))
        carried = F.when(F.col("_tail").isNotNull() & (missing > 0), F.slice("_tail", F.size("_tail") - missing + 1, missing))
        rows = F.when(carried.isNotNull(), F.concat(carried, "_own")).otherwise(F.col("_own"))
        out = out.withColumn(name, F.filter(F.transform(rows, lambda x: x["v"]), lambda v: v.isNotNull()))
        return self._with(out.drop("_own", "_tail"))


def median_of_array(col: Column) -> Column:
    """Median of a short array column, null when empty."""
    s, n = F.array_sort(col), F.size(col)
    lo = F.floor((n - 1) / 2).cast("int")
    hi = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2)


#: Cells for every doubling of a value in the first count of ``group_quantiles``.
CELLS = 1024


def value_cell(col: Column) -> Column:
    """A whole number that never falls while ``col`` rises; values that agree in about three digits share one.

    The borders are moved a little, so that no common number stands on one.
    """
    x = F.nanvl(col.cast("double"), F.lit(float("inf")))
    size = F.least(F.greatest(F.abs(x), F.lit(1e-300)), F.lit(1e300))
    return (F.signum(x) * (F.floor(F.log2(size) * CELLS + 0.37) + 1100 * CELLS)).cast("long")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float],
                    nearest: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """Exact quantiles per key: linear interpolation, or the element at round-half-even(q*(n-1)).

    One lazy plan for keys of any length, which reads ``df`` twice: rows are counted by cells of their value, running
    counts say which cells hold the wanted ranks, and only the values of those cells are ranked. Counts combine before
    they travel, so no task sees the rows of a long key; what a task sorts is the distinct values of one cell.
    ``extra`` adds further aggregates of the same rows.
    """
    keys, extra = list(keys), extra or {}
    rows = df.where(F.col(value).isNotNull())
    src = rows.select(*keys, F.col(value).alias("_v")).withColumn("_cell", value_cell(F.col("_v")))
    out = _ranked_quantiles(src, keys, wanted, nearest)
    if not extra:
        return out
    facts = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in extra.items()])
    return null_safe_join(out, facts, keys)


def _ranked_quantiles(src: DataFrame, keys: list[str], wanted: dict[str, float], nearest: bool) -> DataFrame:
    """Quantiles of ``_v`` by the running counts of its cells, and of the distinct values in those that hold a wanted rank."""
    upto = Window.unboundedPreceding, Window.currentRow
    places = {n: F.lit(float(q)) * (F.col("_n") - 1) for n, q in wanted.items()}
    ends = {n: (F.rint(p), F.rint(p)) if nearest else (F.floor(p), F.ceil(p)) for n, p in places.items()}
    at = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_c") <= i)
    picked = reduce(lambda a, b: a | b, [at(i) for pair in ends.values() for i in pair])
    cells = src.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    cells = cells.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(*upto)))
    cells = cells.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))).where(picked)
    cells = cells.select(*keys, "_cell", (F.col("_upto") - F.col("_c")).alias("_before"), "_n")
    tally = null_safe_join(src, cells, [*keys, "_cell"], "inner").groupBy(*keys, "_cell", "_before", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    own = F.sum("_c").over(Window.partitionBy(*keys, "_cell", "_before", "_n").orderBy("_v").rowsBetween(*upto))
    ranked = tally.withColumn("_upto", F.col("_before") + own).where(picked)
    aggs = []
    for name, (lo, hi) in ends.items():
        aggs += [F.max(F.when(at(lo), F.col("_v"))).alias(f"_lo_{name}"), F.max(F.when(at(hi), F.col("_v"))).alias(f"_hi_{name}")]
    out = ranked.groupBy(*keys, "_n").agg(*aggs)

    def value_of(name: str) -> Column:
        lo, hi, p = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), places[name]
        if nearest:
            return lo.alias(name)
        lo, hi = lo.cast("double"), hi.cast("double")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(name)
    return out.select(*keys, *[value_of(n) for n in wanted])


def group_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "med") -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5})
