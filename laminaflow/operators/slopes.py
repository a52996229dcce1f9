"""Exact median of all pairwise slopes (Theil-Sen) of ordered values, without pairs and without a sample deciding.

With x the position in order, a pair has a slope of at most t exactly when its residuals y - t * x are out of order.
The number of slopes up to t is thus a number of inversions, which takes n log n steps, and the wanted rank is narrowed
between two trial slopes: the slopes of a small set of rows say where to try next, the counts over all rows decide. Once
few slopes are left between the two they are listed from rows whose residuals are close, and the middle ones are taken.

A key of up to ``Sizes.local`` rows is one packed array in one task. Longer keys are cut into chunks of ``Sizes.chunk``
positions. A trial then counts, per chunk, the inversions inside it; the chunks deal their rows out by ranges of the
residual, and per range the inversions between rows of different chunks are counted; pairs that differ in chunk and range
follow from the table of counts per chunk and range. Both ways count the same pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminaflow.operators.ordered import Series, null_safe_join
from laminaflow.session import materialize

class Sizes(NamedTuple):
    """What one task holds at a time; results don't depend on it."""

    #: Rows of a key that one task takes whole.
    local: int = 1 << 18
    chunk: int = 1 << 16
    #: Rows of one range of residuals, about.
    range: int = 1 << 16
    #: Rows whose slopes guide the trials.
    guide: int = 1024
    #: Slopes that are listed at the end.
    listed: int = 1 << 19
    #: Values whose pairs are simply listed all.
    pairs: int = 1024


SIZES = Sizes()
#: Where to try next, as shares of what is left; every trial of a long key sends all its rows.
STEPS = (-0.03, -0.001, 0.001, 0.03)
SEED = 17


def inversions(rank: np.ndarray) -> int:
    """Pairs i < j with rank[i] > rank[j], for a permutation of 0 .. n-1: one stable split per binary digit."""
    n, total = len(rank), 0
    if n < 2:
        return 0
    at, rank = np.arange(n), rank.astype(np.int64)
    for bit in reversed(range(int(n - 1).bit_length())):
        ones = (rank >> bit & 1).astype(bool)
        before = np.cumsum(ones) - ones
        start = rank >> (bit + 1) << (bit + 1)
        own = before - before[start]  # set digits before a row in its group of equal higher digits
        total += int(own[~ones].sum())
        place = np.where(ones, np.minimum(start + (1 << bit), n) + own, at - own)
        out = np.empty_like(rank)
        out[place] = rank
        rank = out
    return total


def ranks(residual: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in the order of (residual, later rows first), so that equal residuals count as out of order."""
    out = np.empty(len(residual), np.int64)
    out[np.lexsort((-x, residual))] = np.arange(len(residual))
    return out


def slopes_up_to(y: np.ndarray, t: float) -> int:
    """Number of pairs whose slope is at most ``t``."""
    x = np.arange(len(y))
    return inversions(ranks(y - t * x, x))


def guide_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(x), 1)
    return np.sort((y[j] - y[i]) / (x[j] - x[i]))


def next_trials(guide: np.ndarray, rank: int, low: float, n_low: int, high: float, n_high: int, tiny: float, turn: int) -> np.ndarray:
    """Slopes to try between ``low`` and ``high``, near where the guide expects the wanted rank.

    They are moved a little, alike in every run, so that they don't meet a slope that many pairs have.
    """
    rng = np.random.default_rng(SEED + turn)
    inside = guide[(guide > low) & (guide <= high)]
    wanted = (rank - n_low + 0.5) / (n_high - n_low)
    shares = np.clip(wanted + np.array(STEPS) * (1 if turn % 3 else 2), 0.0, 1.0)
    if len(inside) >= 16 and turn < 12:
        out = np.quantile(inside, shares)
    else:
        bottom, top = (v if np.isfinite(v) else s * (abs(o) if np.isfinite(o) else 1.0 if not len(guide) else np.abs(guide).max()) * 4.0 + s for v, s, o in ((low, -1, high), (high, 1, low)))
        # halving goes on whatever the guide says
        out = bottom + (top - bottom) * (shares if turn < 24 else np.linspace(0, 1, len(shares) + 2)[1:-1])
    out = out + (np.abs(out) * 1e-13 + tiny) * rng.uniform(0.3, 1, len(out)) * np.where(np.arange(len(out)) % 2, 1, -1)
    return np.unique(out[(out > low) & (out < high)])


def narrowed(low: float, n_low: int, high: float, n_high: int, rank: int, trials: Sequence[float], counts: Sequence[int]) -> tuple[float, int, float, int]:
    for t, c in zip(trials, counts):
        if c <= rank:
            if t > low:
                low, n_low = t, c
        elif t < high:
            high, n_high = t, c
    return low, n_low, high, n_high


def is_narrow(low: float, high: float, tiny: float) -> bool:
    return bool(np.isfinite(low) and np.isfinite(high)) and high - low <= 8 * (tiny + 1e-13 * max(abs(low), abs(high)))


def at_narrow(guide: np.ndarray, low: float, high: float) -> float:
    """The slope between two bounds that no double tells apart from a third: one that a pair of the guide has, or the middle."""
    inside = guide[(guide > low) & (guide <= high)]
    return float(inside[len(inside) // 2]) if len(inside) else 0.5 * (low + high)


def resolution(n: int, least: float, most: float) -> float:
    """Differences of slopes below this are lost in the rounding of the residuals."""
    return 1e-13 * max(most - least, 1e-300) / max(n, 1) ** 0.5 + 1e-300


def listed(y: np.ndarray, low: float, high: float, most: int) -> np.ndarray | None:
    """All slopes in (low, high], sorted; none if too many rows are close."""
    n, x = len(y), np.arange(len(y))
    r = y - low * x
    order = np.argsort(r, kind="stable")
    r, width = r[order], (high - low) * (n - 1)
    upto = np.searchsorted(r, r + width * (1 + 1e-9), "right")
    many = upto - np.arange(n) - 1
    if many.sum() > 16 * most:
        return None
    left = np.repeat(np.arange(n), many)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
    a, b = order[left], order[right]
    ok = a != b
    s = (y[b] - y[a])[ok] / (x[b] - x[a])[ok]
    return np.sort(s[(s > low) & (s <= high)])


def median_slope(y: np.ndarray, sizes: Sizes = SIZES) -> float:
    """Median of all pairwise slopes of values at 0, 1, 2, ...; 0 for fewer than two values."""
    n = len(y)
    if n < 2:
        return 0.0
    if n <= sizes.pairs:
        return float(np.median(guide_slopes(np.arange(n), y)))
    pairs = n * (n - 1) // 2
    y = y - np.median(y)
    picked = np.sort(np.random.default_rng(SEED).choice(n, min(n, sizes.guide), replace=False))
    guide, tiny = guide_slopes(picked, y[picked]), resolution(n, float(y.min()), float(y.max()))
    first, rest = None, np.empty(0)
    found = []
    for rank in {(pairs - 1) // 2: 0, pairs // 2: 0}:
        if first is not None and 0 <= rank - first < len(rest):
            found.append(float(rest[rank - first]))
            continue
        low, n_low, high, n_high, turn = -np.inf, 0, np.inf, pairs, 0
        while True:
            if n_high - n_low <= sizes.listed and np.isfinite(low) and np.isfinite(high):
                rest = listed(y, low, high, sizes.listed)
                if rest is not None and len(rest) > rank - n_low >= 0:
                    first = n_low
                    found.append(float(rest[rank - n_low]))
                    break
            if is_narrow(low, high, tiny):
                found.append(at_narrow(guide, low, high))
                break
            trials = next_trials(guide, rank, low, n_low, high, n_high, tiny, turn)
            low, n_low, high, n_high = narrowed(low, n_low, high, n_high, rank, trials, [slopes_up_to(y, t) for t in trials])
            turn += 1
    return float(np.mean(found))


# ---- on Spark ------------------------------------------------------------------------------------------------------

def theil_sen(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "slope", sizes: Sizes = SIZES) -> DataFrame:
    """Per key: n, and the median of the slopes of all pairs of rows against the row position; 0 for fewer than two rows.

    Null values are left out; a key without values has no row. Values must be finite.
    """
    @F.pandas_udf("double")
    def median_slopes(values: pd.Series) -> pd.Series:
        return pd.Series([median_slope(np.asarray(v, dtype=float), sizes) for v in values])

    keys = list(keys)
    clean = df.where(F.col(value).isNotNull()).withColumn("_y", F.col(value).cast("double"))
    clean = clean.select(*dict.fromkeys([*keys, *order, "_y"]))
    names = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sizes.local)

    def packed(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "_y"))).alias("_p"))
        return lists.select(*keys, F.size("_p").cast("long").alias("n"), median_slopes(F.transform("_p", lambda p: p["_y"])).alias(name))

    if names.isEmpty():
        return packed(clean)
    marked = null_safe_join(clean, materialize(names.select(*keys, F.lit(True).alias("_long")), "long-keys"), keys)
    rows = Series(marked.where("_long").drop("_long"), keys, order).with_row_number("_rn").with_count("n").frame
    return packed(marked.where("_long is null")).unionByName(_long_keys(rows, keys, sizes).withColumnRenamed("_slope", name))


def _ranges(guide_x: np.ndarray, guide_y: np.ndarray, t: float, n: int, rows: int) -> np.ndarray:
    """Borders that cut the residuals at ``t`` into even ranges."""
    parts = max(1, -(-n // rows))
    return np.quantile(guide_y - t * guide_x, np.arange(1, parts) / parts) if parts > 1 else np.empty(0)


STATE = {"key": "string", "n": "long", "rank": "long", "low": "double", "n_low": "long", "high": "double", "n_high": "long", "turn": "int", "trials": "array<double>", "done": "double",
         "rows_x": "array<double>", "rows_y": "array<double>", "tiny": "double", "middle": "double", "ready": "boolean"}


def _guide(state: dict) -> np.ndarray:
    return guide_slopes(np.array(state["rows_x"]), np.array(state["rows_y"]))


def _advance(state: dict, counts: dict[float, int], sizes: Sizes) -> dict:
    """The state after the counts of its trials: narrower, and settled or with new trials."""
    guide = _guide(state)
    bounds = narrowed(state["low"], state["n_low"], state["high"], state["n_high"], state["rank"], state["trials"], [counts[t] for t in state["trials"]])
    low, n_low, high, n_high = bounds
    done = at_narrow(guide, low, high) if is_narrow(low, high, state["tiny"]) else None
    ready = done is None and n_high - n_low <= sizes.listed and bool(np.isfinite(low) and np.isfinite(high))
    trials = [] if done is not None or ready else next_trials(guide, state["rank"], low, n_low, high, n_high, state["tiny"], state["turn"]).tolist()
    return {**state, "low": low, "n_low": n_low, "high": high, "n_high": n_high, "turn": state["turn"] + 1, "trials": trials, "done": done, "ready": ready}


def _begin(state: dict, sizes: Sizes) -> dict:
    return _advance({**state, "low": -np.inf, "n_low": 0, "high": np.inf, "n_high": state["n"] * (state["n"] - 1) // 2, "turn": 0, "trials": []}, {}, sizes)


def _map_states(df: DataFrame, fn) -> DataFrame:
    def kernel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([fn(r) for r in part.to_dict("records")], columns=list(STATE)).astype({"done": float})

    return df.mapInPandas(kernel, ", ".join(f"{c} {kind}" for c, kind in STATE.items()))


def _offset_kind(rows: int) -> str:
    """The fewest bytes that hold a place inside a chunk."""
    return "<u2" if rows <= 1 << 16 else "<u4"


def _pieces(chunk: dict, sizes: Sizes) -> Iterator[dict]:
    """What a chunk sends for every trial of its key: its own inversions, and its rows by range of the residual."""
    y = np.frombuffer(chunk["ys"], "<f8") - chunk["middle"]
    x = np.arange(len(y), dtype=np.int64) + chunk["chunk"] * sizes.chunk
    gx, gy = np.array(chunk["rows_x"]), np.array(chunk["rows_y"]) - chunk["middle"]
    for trial, t in enumerate(chunk["trials"]):
        r = y - t * x
        borders = _ranges(gx, gy, t, chunk["n"], sizes.range)
        place = np.searchsorted(borders, r, "right")  # equal residuals share a range
        own = inversions(ranks(r, x))
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(len(borders) + 2))
        for k in range(len(borders) + 1):
            part = order[edges[k]:edges[k + 1]]
            if len(part):
                yield {"key": chunk["key"], "rank": chunk["rank"], "trial": trial, "t": t, "part": k, "chunk": chunk["chunk"], "m": len(part), "own": own, "r": r[part].tobytes(), "x": part.astype(_offset_kind(sizes.chunk)).tobytes()}
                own = 0


#: What is left of a range of residuals: the inversions between rows of different chunks, those inside chunks that its pieces
#: report, and the rows of each chunk.
COUNTED = "key string, rank long, trial int, t double, part int, across long, own long, chunks array<long>, counts array<long>"


def _between_chunks(group: pa.Table, rows: int) -> pa.Table:
    """The pieces of one range counted, as a row of ``COUNTED``."""
    group = group.sort_by("chunk")
    chunks, counts = group.column("chunk").to_pylist(), group.column("m").to_pylist()
    r = np.concatenate([np.frombuffer(b, "<f8") for b in group.column("r").to_pylist()])
    x = np.concatenate([np.frombuffer(b, _offset_kind(rows)).astype(np.int64) + c * rows for b, c in zip(group.column("x").to_pylist(), chunks)])
    chunk = x // rows
    inside = np.empty(len(x), np.int64)
    inside[np.lexsort((-x, r, chunk))] = np.arange(len(x))
    across = inversions(ranks(r, x)) - inversions(inside)
    first, longs = group.slice(0, 1), pa.list_(pa.int64())
    return pa.table({**{c: first.column(c) for c in ("key", "rank", "trial", "t", "part")}, "across": pa.array([across], pa.int64()),
                     "own": pa.array([sum(group.column("own").to_pylist())], pa.int64()), "chunks": pa.array([chunks], longs), "counts": pa.array([counts], longs)})


def _apart(chunks: list[int], parts: list[int], counts: list[int]) -> int:
    """Pairs of rows whose earlier one is in the higher range, both chunks and ranges being different."""
    c, c_at = np.unique(chunks, return_inverse=True)
    p, p_at = np.unique(parts, return_inverse=True)
    table = np.zeros((len(c), len(p)))
    np.add.at(table, (c_at, p_at), counts)
    after = np.zeros_like(table)  # rows of later chunks
    after[:-1] = np.cumsum(table[::-1], axis=0)[::-1][1:]
    below = np.zeros_like(table)  # of those, rows in lower ranges
    below[:, 1:] = np.cumsum(after, axis=1)[:, :-1]
    return sum(int(a) * int(b) for a, b in zip(table.ravel().tolist(), below.ravel().tolist()))


def _counts(chunks: DataFrame, open_states: DataFrame, sizes: Sizes) -> DataFrame:
    """(key, rank, t, count): how many slopes of the key are at most ``t``, for every trial."""
    kind = "key string, rank long, trial int, t double, part int, chunk long, m long, own long, r binary, x binary"

    def kernel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                for piece in _pieces(row, sizes):
                    yield pd.DataFrame([piece])

    asked = chunks.join(open_states.select("key", "rank", "n", "trials", "rows_x", "rows_y", "middle"), "key")
    # every row travels once per trial; what comes back are counts per chunk and range
    counted = asked.mapInPandas(kernel, kind).groupBy("key", "rank", "trial", "t", "part").applyInArrow(lambda group: _between_chunks(group, sizes.chunk), COUNTED)
    apart = F.udf(_apart, "long")
    cells = F.transform(F.arrays_zip("chunks", "counts"), lambda z: F.struct(z["chunks"].alias("chunk"), F.col("part").alias("part"), z["counts"].alias("m")))
    table = counted.groupBy("key", "rank", "t").agg(F.sum(F.col("own") + F.col("across")).alias("near"), F.flatten(F.collect_list(cells)).alias("l"))
    return table.select("key", "rank", "t", (F.col("near") + apart("l.chunk", "l.part", "l.m")).alias("count"))


def _listed(chunks: DataFrame, states: DataFrame, sizes: Sizes) -> DataFrame:
    """(key, rank, value): the wanted slope of states with few slopes between their bounds, from rows with close residuals."""
    def kernel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                y = np.frombuffer(row["ys"], "<f8")
                x = np.arange(len(y), dtype=np.int64) + row["chunk"] * sizes.chunk
                r, width = y - row["middle"] - row["low"] * x, (row["high"] - row["low"]) * row["n"]
                yield pd.DataFrame({"key": row["key"], "rank": row["rank"], "box": np.floor(r / width).astype(np.int64), "x": x, "y": y})

    rows = chunks.join(states.select("key", "rank", "n", "low", "high", "middle"), "key").mapInPandas(kernel, "key string, rank long, box long, x long, y double")
    near = rows.withColumn("box", F.explode(F.array(F.col("box"), F.col("box") - 1)))
    a, b = rows.alias("a"), near.alias("b")
    # the later row of a pair has the larger residual, by less than one box
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rank") == F.col("b.rank")) & (F.col("a.box") == F.col("b.box")) & (F.col("a.x") < F.col("b.x")))
    slope = F.try_divide(F.col("b.y") - F.col("a.y"), (F.col("b.x") - F.col("a.x")).cast("double")).alias("s")  # the condition may be tested late
    found = met.select(F.col("a.key").alias("key"), F.col("a.rank").alias("rank"), slope).join(states.select("key", "rank", "low", "high", "n_low"), ["key", "rank"])
    found = found.where("s > low and s <= high").groupBy("key", "rank").agg(F.first("n_low").alias("n_low"), F.sort_array(F.collect_list("s")).alias("l"))
    found = found.select("key", "rank", F.get("l", (F.col("rank") - F.col("n_low")).cast("int")).alias("value"))
    # bounds so close that rounding hides the rows between them
    return states.join(found, ["key", "rank"], "left").select("key", "rank", F.coalesce("value", (F.col("low") + F.col("high")) / 2).alias("value"))


def _long_keys(hot: DataFrame, keys: list[str], sizes: Sizes) -> DataFrame:
    """Keys of more rows than a task takes; one turn narrows the bounds of all of them."""
    named = hot.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.struct(*keys).alias("k"), (F.col("_rn") - 1).alias("x"), F.col("_y").alias("y"), "n")
    packed = named.groupBy("key", F.floor(F.col("x") / sizes.chunk).alias("chunk")).agg(
        F.first("k").alias("k"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("x", "y"))).alias("l"))
    as_bytes = F.udf(lambda ys: struct.pack(f"<{len(ys)}d", *ys), "binary")
    packed = materialize(packed.select("key", "k", "n", "chunk", as_bytes(F.transform("l", lambda p: p["y"])).alias("ys"), F.array_min(F.transform("l", lambda p: p["y"])).alias("least"),
                                       F.array_max(F.transform("l", lambda p: p["y"])).alias("most")), "slope-chunks")
    chunks = packed.select("key", "chunk", "ys")

    # rows that guide the trials: about Sizes.guide of each key, the same in every run
    def guides(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                y = np.frombuffer(row["ys"], "<f8")
                rng = np.random.default_rng([SEED, row["chunk"]])
                own = np.sort(rng.choice(len(y), min(len(y), max(1, round(sizes.guide * len(y) / row["n"]))), replace=False))
                yield pd.DataFrame([{"key": row["key"], "rows_x": (own + row["chunk"] * sizes.chunk).astype(float), "rows_y": y[own]}])

    picked = packed.select("key", "chunk", "n", "ys").mapInPandas(guides, "key string, rows_x array<double>, rows_y array<double>")
    picked = picked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("rows_x"), F.col("rows_y")))).alias("g"))
    picked = picked.select("key", F.flatten("g.rows_x").alias("rows_x"), F.flatten("g.rows_y").alias("rows_y"))
    facts = packed.groupBy("key").agg(F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.first("k").alias("k"))
    pairs = F.col("n") * (F.col("n") - 1)
    ranks_of = F.array_distinct(F.array(F.floor((F.floor(pairs / 2) - 1) / 2), F.floor(F.floor(pairs / 2) / 2)))
    fine = F.lit(1e-13) * F.greatest(F.col("most") - F.col("least"), F.lit(1e-300)) / F.sqrt("n") + F.lit(1e-300)
    start = facts.join(picked, "key").select("key", "n", F.explode(ranks_of.cast("array<long>")).alias("rank"), *[F.lit(None).cast(STATE[c]).alias(c) for c in (
        "low", "n_low", "high", "n_high", "turn", "trials", "done", "ready")], "rows_x", "rows_y", fine.alias("tiny"), ((F.col("least") + F.col("most")) / 2).alias("middle")).select(*STATE)
    states = materialize(_map_states(start, lambda row: _begin(row, sizes)), "slope-states")
    while True:
        settled = states.where("done is not null and not isnan(done)").select("key", "rank", F.col("done").alias("value"))
        waiting, ready = states.where(F.size("trials") > 0), states.where("ready")
        if waiting.isEmpty():
            break
        counted = _counts(chunks, waiting, sizes).groupBy("key", "rank").agg(F.map_from_entries(F.collect_list(F.struct("t", "count"))).alias("counts"))

        def step(row: dict) -> dict:
            counts = row.pop("counts")
            return _advance(row, dict(counts), sizes) if counts is not None else row

        joined = states.join(counted, ["key", "rank"], "left").select(*STATE, "counts")
        states = materialize(_map_states(joined, step), "slope-states")
    value = settled.unionByName(_listed(chunks, ready, sizes)).groupBy("key").agg(F.avg("value").alias("_slope"))
    return facts.join(value, "key").select(*[F.col(f"k.{c}").alias(c) for c in keys], "n", "_slope")
