"""Cheapest repair of conversations by a run-length dynamic program.

Rows of a conversation are symbols: the initial of their role, and whether they must go or are cut short. The repaired
roles have to read ``(s?(ua)+)?``, an automaton of four states, so one row is a 4 x 4 matrix over (min, +), and equal
rows in a row are a power of it, which is taken by cached squarings. Costs to the end are carried backwards over the
runs; choices are then unrolled forwards, always the least letter of D < I < K < R that still reaches the least cost.

On Spark the rows travel without their texts, range partitioned and sorted by (conversation, turn, role, digest), and
come out as segments: at most ``SEGMENT_ROWS`` rows of one conversation that stood together, 17 bytes a row.
Conversations that end inside their partition are solved in place. Those that cross a border (two per partition, or one
of any length) are solved by the product of their segments' matrices: costs to the end per segment, then every segment
unrolled from each of the four states, then the chain of states that begins at the start.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.llm.tables import map_batches, stored

BLANK_CHARS = " \t\n\v\f\r"
SEGMENT_ROWS = 1 << 20
INF = 1 << 60
#: States: nothing yet, after s, after u, after a. The empty conversation and one that ends with a are whole.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FILL = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
DELETE, CHANGE, INSERT, CUT = 3, 2, 2, 1
#: A symbol is role * 3 + fault.
ROLES = "sua?"
FINE, SHORT, MUST_GO = range(3)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


# ---- the program ---------------------------------------------------------------------------------------------------

def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(INF, min(a[i][k] + v[k] for k in range(4))) for i in range(4))


UNIT: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def _fill_matrix() -> Matrix:
    """Cheapest insertions between two states."""
    cost = [[INF] * 4 for _ in range(4)]
    for i in range(4):
        state, spent = i, 0
        while cost[i][state] > spent:
            cost[i][state] = spent
            state, spent = FILL[state][1], spent + INSERT
    return tuple(map(tuple, cost))


FILLED = _fill_matrix()
#: Costs to the end after the last row.
FINISH: Vector = _apply(FILLED, (0, INF, INF, 0))


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, insertions apart, in the order of the letters."""
    role, fault = ROLES[symbol // 3], symbol % 3
    out = [("D", DELETE, state)]
    if fault != MUST_GO:
        if (state, role) in NEXT:
            out.append(("K", CUT * (fault == SHORT), NEXT[state, role]))
        out.append(("R", CHANGE + CUT * (fault == SHORT), FILL[state][1]))
    return out


@functools.lru_cache(maxsize=None)
def row_matrix(symbol: int) -> Matrix:
    rows = []
    for state in range(4):
        best = [INF] * 4
        for _, cost, to in choices(symbol, state):
            best[to] = min(best[to], cost)
        rows.append(tuple(best))
    return _times(FILLED, tuple(rows))


@functools.lru_cache(maxsize=None)
def binary_power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k equal rows."""
    if not k:
        return row_matrix(symbol)
    half = binary_power(symbol, k - 1)
    return _times(half, half)


def runs_of(symbols: np.ndarray) -> list[tuple[int, int]]:
    """(symbol, length) of the runs of equal symbols."""
    if not len(symbols):
        return []
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    return list(zip(symbols[first].tolist(), np.diff(np.append(first, len(symbols))).tolist()))


def before_run(symbol: int, n: int, after: Vector) -> Vector:
    """Costs to the end before a run, from those after it: one product per binary digit of its length."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _apply(binary_power(symbol, k), after)
    return after


def segment_matrix(symbols: np.ndarray) -> Matrix:
    out = UNIT
    for symbol, n in runs_of(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, binary_power(symbol, k))
    return out


@functools.lru_cache(maxsize=1 << 16)
def _step(symbol: int, after: Vector, state: int) -> tuple[str, int]:
    """Letters for one row, its insertions included, and the next state; ``after`` are costs to the end after the row."""
    letters = ""
    best = _apply(row_matrix(symbol), after)
    while True:
        options = [(letter, cost + after[to], to) for letter, cost, to in choices(symbol, state)]
        if options[0][1] == best[state]:
            return letters + "D", state
        role, to = FILL[state]
        if INSERT + best[to] == best[state]:
            letters, state = letters + "I", to
            continue
        return next((letters + letter, to) for letter, cost, to in options if cost == best[state])


@functools.lru_cache(maxsize=1 << 16)
def _previous(symbol: int, after: Vector) -> tuple[Vector, int]:
    """Costs before a row, less their least, and that least."""
    before = _apply(row_matrix(symbol), after)
    least = min(before)
    return tuple(min(INF, x - least) if x < INF else INF for x in before), least


def _lowered(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least if x < INF else INF for x in v)


def unroll(symbols: np.ndarray, after: Vector, state: int) -> tuple[str, int]:
    """Letters for all rows from ``state``, and the state they end in."""
    runs, ends = runs_of(symbols), [_lowered(after)]
    for symbol, n in reversed(runs):
        ends.append(_lowered(before_run(symbol, n, ends[-1])))
    out = []
    for (symbol, n), end in zip(runs, reversed(ends[:-1])):
        behind = [end]
        for _ in range(n - 1):
            behind.append(_previous(symbol, behind[-1])[0])
        for v in reversed(behind):
            letters, state = _step(symbol, v, state)
            out.append(letters)
    return "".join(out), state


def last_letters(state: int) -> str:
    """Insertions after the last row."""
    out = ""
    while state not in (START, AFTER_A):
        out, state = out + "I", FILL[state][1]
    return out


def solve(symbols: np.ndarray) -> tuple[int, str]:
    """Least cost and the least audit of it, of a whole conversation."""
    cost = FINISH
    for symbol, n in reversed(runs_of(symbols)):
        cost = before_run(symbol, n, cost)
    letters, state = unroll(symbols, FINISH, START)
    return cost[START], letters + last_letters(state)


# ---- damage --------------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows with the faults that crc32(``conv_id:turn``) % 20 deals out; nulls read as a space.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. Keys and turns stay null.
    """
    spaced = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    copies = F.when(lot == 0, F.array().cast("array<int>")).when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def _order(rows: DataFrame) -> DataFrame:
    """Nulls of role and text read as a space; ``k`` and ``t`` order conversations and turns, nulls first."""
    role, text = (F.coalesce(rows[c], F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("conv_id").cast("long").alias("k"), F.col("turn").cast("long").alias("t"), role.alias("role"), _digest(role, text).alias("digest"), text.alias("text"))


def _sorted(rows: DataFrame) -> list[Column]:
    return [F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("role"), F.col("digest")]


# ---- segments ------------------------------------------------------------------------------------------------------

SEGMENT = ("k long, seg long, whole boolean, n long, symbols binary, digests binary, first_turn long, last_turn long, n_turns long, first_role string, last_role string, illegal long")
LEGAL = ("su", "ua", "au")


def _segments(rows: DataFrame) -> DataFrame:
    """One row per stretch of a conversation: ``symbols`` are role * 3 + (2 blank, 1 cut short, 0 fine) before repeats are known."""
    bare = F.rtrim("text", F.lit(BLANK_CHARS))
    flag = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    role = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    kind = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)
    slim = _order(rows).select("k", "t", "role", "digest", (kind * 3 + flag).cast("tinyint").alias("symbol"), F.substring("role", 1, 1).alias("initial"))
    placed = slim.repartitionByRange(*_sorted(slim)).sortWithinPartitions(*_sorted(slim)).drop("role")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seg = TaskContext.get().partitionId() << 33
        parts: list[pa.RecordBatch] = []
        waiting = None  # the last segment: whole unless the partition ends with it

        def close(whole: bool) -> dict:
            nonlocal seg
            rows = pa.Table.from_batches(parts)
            turns, symbols = rows.column("t"), rows.column("symbol").to_numpy().astype(np.uint8)
            known = turns.drop_null().to_numpy()
            initials = rows.column("initial").to_pylist()
            pairs = sum(n for pair, n in zip(*_counted(initials)) if pair not in LEGAL)
            seg += 1
            return {"k": [rows.column("k")[0].as_py()], "seg": [seg], "whole": [whole], "n": [rows.num_rows], "symbols": [symbols.tobytes()],
                    "digests": [b"".join(rows.column("digest").to_pylist())], "first_turn": [int(known[0]) if len(known) else None],
                    "last_turn": [int(known[-1]) if len(known) else None], "n_turns": [int((np.diff(known) != 0).sum()) + 1 if len(known) else 0],
                    "first_role": [initials[0]], "last_role": [initials[-1]], "illegal": [pairs]}

        first, size, current = True, 0, None
        for batch in batches:
            keys = batch.column("k")
            filled = keys.fill_null(-1).to_numpy()
            missing = keys.is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(False, (filled[1:] != filled[:-1]) | (missing[1:] != missing[:-1])))
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                name = (bool(missing[a]), int(filled[a]))
                if name != current:
                    if parts:
                        yield close(not first)
                        first = False
                    parts, size, current = [], 0, name
                while a < b:
                    take = min(b - a, SEGMENT_ROWS - size)
                    parts.append(batch.slice(a, take))
                    a, size = a + take, size + take
                    if size == SEGMENT_ROWS:  # a segment of a longer stretch never counts as whole
                        yield close(False)
                        parts, size, first = [], 0, True
        if parts:
            yield close(False)

    return stored(map_batches(placed, kernel, SEGMENT), "segments")


def _counted(initials: list[str]) -> tuple[list[str], list[int]]:
    """Pairs of neighbours and how often each occurs."""
    found: dict[str, int] = {}
    for a, b in zip(initials, initials[1:]):
        found[a + b] = found.get(a + b, 0) + 1
    return list(found), list(found.values())


SOLVED = "k long, seg long, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, letters string"
JUDGED = "k long, seg long, blank long, duplicate long, truncated long, symbols binary, matrix array<long>, first_turn long, last_turn long, n_turns long, first_role string, last_role string, illegal long"


def with_repeats(symbols: np.ndarray, digests: bytes, earlier: set[bytes]) -> tuple[np.ndarray, int, int, int]:
    """Final symbols and the numbers of blank, duplicate and truncated rows; ``earlier`` are digests of rows before these."""
    rows = [digests[a:a + 16] for a in range(0, len(digests), 16)]
    fault, seen, repeated = symbols % 3, set(earlier), np.zeros(len(rows), bool)
    for at, row in enumerate(rows):
        if row in seen:
            repeated[at] = True
        else:
            seen.add(row)
    gone = repeated | (fault == MUST_GO)
    # what must go is one symbol, whoever said it
    return np.where(gone, 3 * ROLES.index("?") + MUST_GO, symbols).astype(np.uint8), int((fault == MUST_GO).sum()), int((repeated & (fault != MUST_GO)).sum()), int((~gone & (fault == SHORT)).sum())


def _solve_whole(segments: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {c: [] for c in ("blank", "duplicate", "truncated", "cost", "letters")}
            for symbols, digests in zip(batch.column("symbols").to_pylist(), batch.column("digests").to_pylist()):
                final, *counts = with_repeats(np.frombuffer(symbols, np.uint8), digests, set())
                for name, value in zip(out, (*counts, *solve(final))):
                    out[name].append(value)
            yield {"k": batch.column("k"), "seg": batch.column("seg"), "illegal": batch.column("illegal"), "gaps": batch.column("gaps"), **out}

    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    return map_batches(segments.select("k", "seg", "symbols", "digests", "illegal", gaps), kernel, SOLVED)


def _judged(segments: DataFrame) -> DataFrame:
    """Open segments with repeats of earlier segments known, and their matrices."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [list({d[a:a + 16] for a in range(0, len(d), 16)}) for d in batch.column("digests").to_pylist()]
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield {"k": batch.column("k").take(pa.array(row)), "seg": batch.column("seg").to_numpy()[row], "digest": [d for x in sets for d in x]}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        same = ("k", "seg", "first_turn", "last_turn", "n_turns", "first_role", "last_role", "illegal")
        for batch in batches:
            out = {c: [] for c in ("symbols", "blank", "duplicate", "truncated", "matrix")}
            for symbols, digests, earlier in zip(*(batch.column(c).to_pylist() for c in ("symbols", "digests", "earlier"))):
                final, *counts = with_repeats(np.frombuffer(symbols, np.uint8), digests, set(earlier or ()))
                for name, value in zip(out, (final.tobytes(), *counts, [x for row in segment_matrix(final) for x in row])):
                    out[name].append(value)
            yield {**{c: batch.column(c) for c in same}, **out}

    said = map_batches(segments.select("k", "seg", "digests"), distinct, "k long, seg long, digest binary")
    # a conversation has few segments, whatever its length, so the lists are short
    places = said.groupBy("k", "digest").agg(F.min("seg").alias("least"), F.collect_list("seg").alias("segs")).where(F.size("segs") > 1)
    later = places.select("digest", "least", F.explode("segs").alias("seg")).where("seg > least").groupBy("seg").agg(F.collect_list("digest").alias("earlier"))
    return stored(map_batches(segments.join(later, "seg", "left"), kernel, JUDGED), "judged-segments")


def _matrix(flat: list[int]) -> Matrix:
    return tuple(tuple(flat[4 * i:4 * i + 4]) for i in range(4))


def _solve_open(segments: DataFrame) -> DataFrame:
    """Conversations of several segments: costs to the end by their matrices, four ways through each, then the chain."""
    judged = _judged(segments)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {c: [] for c in ("k", "seg", "after", "illegal", "gaps", "cost")}
            for k, parts in zip(batch.column("k").to_pylist(), batch.column("parts").to_pylist()):
                after, behind = FINISH, []
                for part in reversed(parts):
                    behind.append(after)
                    after = _apply(_matrix(part["matrix"]), after)
                illegal, gaps, turn = 0, 0, None
                for i, part in enumerate(parts):
                    illegal += part["illegal"] + (i > 0 and parts[i - 1]["last_role"] + part["first_role"] not in LEGAL)
                    if part["n_turns"]:
                        gaps -= part["n_turns"] - (part["first_turn"] == turn)
                        turn = part["last_turn"]
                known = [p for p in parts if p["n_turns"]]
                gaps += known[-1]["last_turn"] - known[0]["first_turn"] + 1 if known else 0
                for i, (part, v) in enumerate(zip(parts, reversed(behind))):
                    for name, value in zip(out, (k, part["seg"], list(v), illegal if not i else 0, gaps if not i else 0, after[START] if not i else 0)):
                        out[name].append(value)
            yield out

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [[unroll(np.frombuffer(s, np.uint8), tuple(v), state) for state in range(4)]
                     for s, v in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist())]
            yield {**{c: batch.column(c) for c in ("k", "seg", "blank", "duplicate", "truncated", "illegal", "gaps", "cost")},
                   "ways": [[w for w, _ in f] for f in found], "ends": [[e for _, e in f] for f in found]}

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            segs, states, tails = [], [], []
            for parts in batch.column("parts").to_pylist():
                state = START
                for i, part in enumerate(parts):
                    segs.append(part["seg"])
                    states.append(state)
                    state = part["ends"][state]
                    tails.append(last_letters(state) if i == len(parts) - 1 else "")
            yield {"seg": segs, "state": states, "tail": tails}

    def per_conversation(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("seg", *columns))).alias("parts"))

    summed = map_batches(per_conversation(judged, "matrix", "first_turn", "last_turn", "n_turns", "first_role", "last_role", "illegal"), sums,
                         "k long, seg long, after array<long>, illegal long, gaps long, cost long")
    tried = map_batches(judged.select("seg", "blank", "duplicate", "truncated", "symbols").join(summed, "seg"), ways,
                        "k long, seg long, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, ways array<string>, ends array<int>")
    tried = stored(tried, "segment-ways")
    states = map_batches(per_conversation(tried, "ends").select("parts"), chain, "seg long, state int, tail string")
    letters = F.concat(F.col("ways")[F.col("state")], F.col("tail")).alias("letters")
    return tried.join(states, "seg").select("k", "seg", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", letters)


def repair_plan(rows: DataFrame) -> DataFrame:
    """(k, seg, blank, duplicate, truncated, illegal, gaps, cost, letters) per segment of every conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text. Rows are taken by turn (nulls first; ties by role, then by the md5 of role and
    text); null roles and texts read as one space, null keys are one conversation. Letters in the order of ``seg`` are the
    audit: D(elete), I(nsert before), K(eep), R(erole); the numbers of a conversation are the sums over its segments. A
    role whose first letter is none of s, u, a (the empty one too) can't be kept. No rows, no plan; other columns are not
    read. Texts don't travel here, so their length is of no matter.
    """
    segments = _segments(rows)
    return stored(_solve_whole(segments.where("whole")).unionByName(_solve_open(segments.where(~F.col("whole")))), "repair-plan")


# ---- repaired rows -------------------------------------------------------------------------------------------------

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _with_plan(rows: DataFrame, plan: DataFrame, keys: DataFrame) -> DataFrame:
    """Plan and rows of every conversation next to one another, in order; ``kind`` 0: key, 1: segment, 2: row."""
    empty = {"seg": F.lit(0).cast("long"), "t": F.lit(None).cast("long"), **{n: F.lit(0).cast("long") for n in NUMBERS}, **{c: F.lit("") for c in ("letters", "role", "text")},
             "digest": F.lit(b"")}
    columns = ["k", "kind", *empty]
    parts = [keys.select(F.col("conv_id").cast("long").alias("k")).distinct().withColumn("kind", F.lit(0)), plan.withColumn("kind", F.lit(1)), _order(rows).withColumn("kind", F.lit(2))]
    both = [p.select(*[F.col(c) if c in p.columns else empty[c].alias(c) for c in columns]) for p in parts]
    together = both[0].unionByName(both[1]).unionByName(both[2])
    order = [F.col("k").asc_nulls_first(), F.col("kind"), F.col("seg"), F.col("t").asc_nulls_first(), F.col("role"), F.col("digest")]
    return together.repartition("k").sortWithinPartitions(*order).drop("seg", "t", "digest")


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", key, numbers, audit), then ("row", letter, role, text) for every letter, for each conversation.

    Holds one batch and one audit; rows are passed on as they come.
    """
    key, numbers, pieces, audit, at, state = None, None, [], None, 0, START

    def filled() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = FILL[state]
            at += 1
            yield "row", "I", role, ""

    def begin() -> Iterator[tuple]:
        nonlocal audit, at, state
        audit, at, state = "".join(pieces), 0, START
        yield "begin", key, numbers, audit

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("k", "kind", "letters", "role", "text")]
        counts = list(zip(*(batch.column(n).to_pylist() for n in NUMBERS)))
        for i, (k, kind, letters, role, text) in enumerate(zip(*columns)):
            if kind == 0:
                if numbers is not None:
                    if audit is None:
                        yield from begin()
                    yield from filled()
                key, numbers, pieces, audit = k, (0,) * len(NUMBERS), [], None
            elif kind == 1:
                numbers = tuple(a + b for a, b in zip(numbers, counts[i]))
                pieces.append(letters)
            else:
                if audit is None:
                    yield from begin()
                yield from filled()
                letter = audit[at]
                at += 1
                if letter == "R":
                    role, state = FILL[state]
                elif letter == "K":
                    state = NEXT[state, role[0]]
                yield "row", letter, role, text
    if numbers is not None:
        if audit is None:
            yield from begin()
        yield from filled()


def repaired_turns(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): every row and insertion in order with its letter; D rows as they were.

    The repaired conversation are the rows whose edit is not D. See ``repair_plan`` for nulls and ties.
    """
    plan = repair_plan(rows) if plan is None else plan

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, size = [], 0
        key, place = None, 0
        for event in repaired(batches):
            if event[0] == "begin":
                key, place = event[1], 0
                continue
            out.append((key, place, *event[1:]))
            place, size = place + 1, size + len(event[3])
            if len(out) >= 1000 or size > 1 << 22:
                yield dict(zip(("conv_id", "place", "edit", "role", "text"), map(list, zip(*out))))
                out, size = [], 0
        if out:
            yield dict(zip(("conv_id", "place", "edit", "role", "text"), map(list, zip(*out))))

    return map_batches(_with_plan(rows, plan, rows), kernel, "conv_id long, place long, edit string, role string, text string")


def repair_digests(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Per conversation of ``keys``: its numbers, the audit, and the sha256 of the repaired ``role:text`` lines.

    A conversation without rows has zeros, an empty audit and the hash of nothing. Its lines are hashed as they pass, so
    a conversation of any length needs the memory of its audit only.
    """
    names = ("conv_id", *NUMBERS, "audit", "repaired_sha256")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, head, state, lines = [], None, None, 0

        def close() -> None:
            out.append((head[1], *head[2], head[3], state.hexdigest()))

        for event in repaired(batches):
            if event[0] == "begin":
                if head:
                    close()
                head, state, lines = event, hashlib.sha256(), 0
            elif event[1] != "D":
                state.update(f"{chr(10) if lines else ''}{event[2]}:{event[3]}".encode())
                lines += 1
            if len(out) >= 1000:
                yield dict(zip(names, map(list, zip(*out))))
                out.clear()
        if head:
            close()
        if out:
            yield dict(zip(names, map(list, zip(*out))))

    return map_batches(_with_plan(rows, repair_plan(rows), keys), kernel, "conv_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", audit string, repaired_sha256 string")
