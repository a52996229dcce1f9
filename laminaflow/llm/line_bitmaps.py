"""Lines that several documents share, as bitmaps of the lines that each document keeps.

A document sends one record per distinct long line: the line's 128-bit hash, its own key and the places of the line. The
records are range partitioned on (hash, document, place) and sorted the same way, largest document first, so a line that
a third of all documents hold is spread over many tasks. Each task streams over its records: the first document of a run
of equal hashes keeps the line, and all others lose it as soon as a run is known to have enough documents. Only the runs
at the borders of a partition can go on elsewhere; their records wait for a table of at most two rows per partition.
What comes back is a compressed bitmap per document that loses something, never a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.llm.tables import map_batches, stored, texts_of

#: What is stripped at both ends of a line before it is compared.
BLANK = b" \t\n\v\f\r"
#: Records of an undecided run that a task holds; more of them wait in the table like those of a border.
HELD_ROWS = 100_000
DROPPED, OPEN, SEEN = 0, 1, 2
#: Stands for a null key; documents without a key count as one document, smaller than all others.
NO_KEY = -(1 << 63)

RECORD = "h1 long, h2 long, doc long, tag long, n_lines int, places array<int>"
FIELDS = ["h1", "h2", "doc", "tag", "n_lines", "places"]


def _doc(docs: DataFrame, key: str) -> Column:
    return F.coalesce(docs[key].cast("long"), F.lit(NO_KEY))


def _tag(docs: DataFrame, text: str) -> Column:
    """Tells texts of the same key apart; rows that agree in key and text get the same answer."""
    return F.xxhash64(F.coalesce(docs[text], F.lit("")))


def line_places(text: str, least_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the places of every line key of at least ``least_chars`` code points."""
    lines, found = text.encode().split(b"\n"), {}
    for place, line in enumerate(lines):
        if len(line) >= least_chars:
            line = line.strip(BLANK).lower()  # of bytes: changes A-Z only
            if len(line) >= 4 * least_chars or len(line) >= least_chars and len(line.decode()) >= least_chars:
                found.setdefault(line, []).append(place)
    return len(lines), found


def _records(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            hashes, places, counts, sizes = [], [], [], []
            for t in texts_of(batch, "text"):
                n, found = line_places(t, least_chars)
                hashes += map(xxhash.xxh3_128_digest, found)
                places += found.values()
                counts.append(len(found))
                sizes.append(n)
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(len(counts)), counts)
            yield {"h1": both[:, 0], "h2": both[:, 1], "doc": batch.column("doc").to_numpy()[row], "tag": batch.column("tag").to_numpy()[row],
                   "n_lines": np.array(sizes, np.int32)[row], "places": places}

    return map_batches(docs.select(_doc(docs, key).alias("doc"), _tag(docs, text).alias("tag"), docs[text].alias("text")), kernel, RECORD)


class _Run:
    """A run of equal hashes that may reach over the border of what a task sees, with its first documents."""

    def __init__(self, name: tuple[int, int], least_docs: int):
        self.name, self.least, self.docs = name, least_docs, []

    def see(self, docs: np.ndarray) -> None:
        if len(self.docs) < self.least and len(docs):
            new = docs[np.append(True, docs[1:] != docs[:-1])]
            self.docs += [int(d) for d in new[:self.least + 1] if not self.docs or d != self.docs[-1]]
            del self.docs[self.least:]


def first_documents(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[dict]:
    """Streams over records sorted by (hash, document descending); yields dropped and open records, and border runs.

    ``state`` is DROPPED (the record's lines go), OPEN (its run crosses a border) or SEEN (a document of a border run;
    the first ``least_docs`` of the run in this partition). Repeats of a record are answered once.
    """
    opened: _Run | None = None  # its records leave as OPEN
    decided: _Run | None = None  # its records leave as DROPPED, but for those of the first document
    held: pa.Table | None = None  # records of the last run, with too few documents so far
    borders: list[_Run] = []

    def out(rows: pa.Table, which: np.ndarray, state: int) -> dict:
        part = rows.take(pa.array(which))
        return {**{c: part.column(c).combine_chunks() for c in FIELDS}, "state": np.full(len(which), state, np.int8)}

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        h1, h2, doc, tag = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc", "tag"))
        if opened is None and decided is None and not borders:
            opened = _Run((int(h1[0]), int(h2[0])), least_docs)
            borders.append(opened)
        start = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        fresh = start | np.append(True, doc[1:] != doc[:-1])
        new = fresh | np.append(True, tag[1:] != tag[:-1])
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        last, name = len(first) - 1, (int(h1[-1]), int(h2[-1]))
        n_docs = np.bincount(run, fresh).astype(np.int64)
        keeper, gone = doc[first].copy(), n_docs >= least_docs
        ready = np.ones(len(first), bool)
        if opened is not None:
            if (int(h1[0]), int(h2[0])) == opened.name:
                mine = np.flatnonzero(run == 0)
                opened.see(doc[mine])
                yield out(rows, mine[new[mine]], OPEN)
                ready[0] = False
            if name != opened.name:
                opened = None
        if decided is not None:
            if (int(h1[0]), int(h2[0])) == decided.name:
                keeper[0], gone[0] = decided.docs[0], True
            if name != decided.name:
                decided = None
        held = None
        if ready[last]:
            if not gone[last]:
                at = int(first[last])
                ready[last] = False
                if len(doc) - at > HELD_ROWS:
                    opened = _Run(name, least_docs)
                    opened.see(doc[at:])
                    borders.append(opened)
                    yield out(rows, at + np.flatnonzero(new[at:]), OPEN)
                else:
                    held = rows.slice(at)
            elif decided is None:
                decided = _Run(name, least_docs)
                decided.see(doc[first[last]:])
        drop = np.flatnonzero(ready[run] & gone[run] & new & (doc != keeper[run]))
        if len(drop):
            yield out(rows, drop, DROPPED)
    if held is not None:
        tail = _Run((int(held.column("h1")[0].as_py()), int(held.column("h2")[0].as_py())), least_docs)
        tail.see(held.column("doc").to_numpy())
        borders.append(tail)
        yield out(held, np.arange(held.num_rows), OPEN)
    if decided is not None:
        borders.append(decided)
    for border in borders:
        n = len(border.docs)
        yield {"h1": [border.name[0]] * n, "h2": [border.name[1]] * n, "doc": border.docs, "tag": [0] * n, "n_lines": [0] * n, "places": [[]] * n, "state": [SEEN] * n}


def pack_bits(kept: np.ndarray) -> bytes:
    """One bit per line, lowest bit first, compressed."""
    return zlib.compress(np.packbits(kept, bitorder="little").tobytes(), 6)


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), bitorder="little")[:n].astype(bool)


def lossy_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc, tag, n_lines, n_dropped, keep): bitmaps of the texts that lose lines, one row per distinct (key, text).

    Lines are compared after stripping white space at both ends and lower-casing A-Z, if at least ``least_chars`` code
    points are left; those in at least ``least_docs`` documents stay in the largest key that holds them, with all their
    repeats there. ``doc`` is the key (null: ``NO_KEY``), ``tag`` a hash of the text.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tag"), F.col("places")[0]]
    records = _records(docs, key, text, least_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(map_batches(records, lambda batches: first_documents(batches, least_docs), f"{RECORD}, state tinyint"), "line-runs")
    border = found.where(F.col("state") == SEEN).groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= least_docs)
    # at most two runs per partition, and one more for every HELD_ROWS records of one document
    late = found.where(F.col("state") == OPEN).join(F.broadcast(border), ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    gone = found.where(F.col("state") == DROPPED).select("doc", "tag", "n_lines", "places").unionByName(late.select("doc", "tag", "n_lines", "places"))
    packed = gone.groupBy("doc", "tag").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes, lists = batch.column("n_lines").to_numpy(), batch.column("places")
            keeps, dropped = [], []
            for n, places in zip(sizes.tolist(), lists):
                kept = np.ones(n, bool)
                kept[places.values.to_numpy()] = False
                keeps.append(pack_bits(kept))
                dropped.append(n - int(kept.sum()))
            yield {"doc": batch.column("doc"), "tag": batch.column("tag"), "n_lines": sizes, "n_dropped": dropped, "keep": keeps}

    return map_batches(packed, kernel, "doc long, tag long, n_lines int, n_dropped int, keep binary")


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Per row of ``docs``: key, n_lines, n_dropped, keep (compressed bitmap of its lines; null where all stay).

    Null and empty texts are one empty line. Rows that share a key are one document; those without a key are one
    document too, smaller than all others. Repeated rows each get their row. Other columns are not read, so their names
    cannot clash. A very long text is one record per distinct line; an empty table gives an empty one.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key], _doc(docs, key).alias("_doc"), _tag(docs, text).alias("_tag"),
                       (F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).alias("_lines"))
    found = lossy_bitmaps(docs, key, text, least_chars, least_docs).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "n_dropped", "keep")
    out = rows.join(found, ["_doc", "_tag"], "left")
    return out.select(rows[key], F.col("_lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Per row of ``docs``: key, n_lines, n_dropped, kept (the lines that stay, joined by line ends).

    The bitmaps of ``lossy_bitmaps`` are applied to the texts; nulls, ties and names are treated as in ``keep_bitmaps``.
    The texts cross the network once, at every size of the table.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("_key"), _doc(docs, key).alias("doc"), _tag(docs, text).alias("tag"), docs[text].alias("_text"))
    found = lossy_bitmaps(docs, key, text, least_chars, least_docs).select("doc", "tag", "keep")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            kept, sizes, dropped = [], [], []
            for t, bits in zip(texts_of(batch, "_text"), batch.column("keep").to_pylist()):
                n = t.count("\n") + 1
                if bits is not None:
                    stay = [line for line, yes in zip(t.split("\n"), unpack_bits(bits, n).tolist()) if yes]
                    t = "\n".join(stay)
                sizes.append(n)
                dropped.append(n - len(stay) if bits is not None else 0)
                kept.append(t)
            yield {key: batch.column("_key"), "n_lines": sizes, "n_dropped": dropped, "kept": kept}

    joined = rows.join(found.hint("merge"), ["doc", "tag"], "left").select("_key", "_text", "keep")
    return map_batches(joined, kernel, f"`{key}` {kind}, n_lines long, n_dropped long, kept string")
