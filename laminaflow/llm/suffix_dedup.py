"""Removal of long repeats with suffix arrays sorted in two stages.

A window is a stretch of ``length`` bytes. Suffixes are spread over the cluster by the window's minimiser: the smallest
hash among its stretches of ``ANCHOR`` bytes, which equal windows share wherever they stand. Consecutive windows with
one minimiser travel as one segment. Minimisers that only one text has are left at home, after their texts have been
counted over the corpus. Each bucket sorts the suffixes of its segments in two stages: suffixes smaller than their
successors are sorted directly, all others are induced by scanning the buckets of first bytes from small to large.
Common prefixes of neighbours then give classes of equal windows; each class learns its smallest document, and every
later document drops the bytes that such a window covers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminaflow.llm.blocks import NO_KEY, Block, Polynomial, distinct_texts, feature_totals, mix, pack_blocks, totals_of, with_answers
from laminaflow.llm.tables import map_batches, stored, stored_alone

LENGTH = 50
ANCHOR = 19
#: Window starts worked on at once, whatever a text's length: as many as a core's own cache holds.
STRIDE = 1 << 16
#: Base of the polynomial over a stretch of ``ANCHOR`` bytes.
BASE = 0x9E3779B97F4A7C15
#: Segments that one bucket sorts; an anchor with more of them is spread over its single windows.
BUCKET_SEGMENTS = 30_000
HASHES = Polynomial(7), Polynomial(11)
LOW = np.uint64((1 << 24) - 1)


# ---- segments of a block -------------------------------------------------------------------------------------------

def _anchor_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at every place, by doubling."""
    times = lambda x, n: x * np.uint64(pow(BASE, n, 1 << 64))
    powers, out, done = {1: data.astype(np.uint64) + np.uint64(1)}, None, 0
    step = 1
    while step * 2 <= size:
        half = powers[step]
        powers[step * 2] = times(half[:-step], step) + half[step:]
        step *= 2
    for step in sorted(powers, reverse=True):
        if size & step:
            part = powers[step][done:]
            out = part if out is None else times(out[:len(part)], step) + part[:len(out)]
            done += step
    return mix(out)


def segments(block: Block, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: first and last window start, minimiser hash, text of the block."""
    parts, width = [], length - anchor + 1
    for at in range(0, len(block.data) - length + 1, STRIDE):
        data = block.data[at:at + STRIDE + length - 1]
        starts = np.arange(len(data) - length + 1)
        hashes = _anchor_hashes(data, anchor)
        least = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        done = 1
        while done < width:  # minimum over ``width`` places
            step = min(done, width - done)
            least = np.minimum(least[:len(least) - step], least[step:])
            done += step
        place = (least[:len(starts)] & LOW).astype(np.int64)
        ends = np.clip(block.cut[1:] - at, 0, len(starts))
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        whole = starts + at + length < block.cut[text + 1]  # the last byte of a text's stretch is the line end
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        stop = np.append(np.flatnonzero(new | ~whole), len(starts))
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        parts.append((first + at, last + at, hashes[place[first]], text[first]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _features(length: int, anchor: int):
    def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Minimisers of the block and how many of its texts have each."""
        _, _, hashes, text = segments(block, length, anchor)
        order = np.lexsort((text, hashes))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        return np.unique(hashes[new], return_counts=True)
    return features


def shared_segments(blocks: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, k1, k2, block, text, doc, start, windows, content) of the segments whose minimiser several texts have.

    (k1, k2) is a hash of the content. In a block, the content stands with the occurrence of the smallest document only.
    """
    def kernel(block: Block, answers: pa.Table) -> dict:
        first, last, hashes, text = segments(block, length, anchor)
        known = np.unique(hashes)
        count = totals_of(answers, known)
        keep = count[np.searchsorted(known, hashes)] > 1 if len(known) else np.zeros(len(hashes), bool)
        first, stop, hashes, text = first[keep], last[keep] + length, hashes[keep], text[keep]
        keys = []
        for polynomial in HASHES:
            polynomial.prepare(block.data)
            keys.append(polynomial.stretch(first, stop).view(np.int64))
        doc = block.ids[text]
        order = np.lexsort((doc, keys[1], keys[0]))
        head = np.ones(len(order), bool)
        head[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
        content: list = [None] * len(order)
        raw = block.data.tobytes()
        for k in order[head]:
            content[k] = raw[first[k]:stop[k]]
        return {"anchor": hashes.view(np.int64), "k1": keys[0], "k2": keys[1], "block": np.full(len(first), block.number), "text": text, "doc": doc,
                "start": first - block.cut[text], "windows": stop - length - first + 1, "content": content}

    def found() -> DataFrame:
        totals = feature_totals(blocks, _features(length, anchor), 2 / (length - anchor + 2))
        return with_answers(blocks, totals, kernel, "anchor long, k1 long, k2 long, block long, text long, doc long, start long, windows long, content binary")

    return stored_alone(found, "segments")


# ---- suffix array of a bucket --------------------------------------------------------------------------------------

class Suffixes:
    """Sorted suffixes of many short strings, of which only the first ``windows[i]`` places of each are wanted."""

    def __init__(self, contents: list[bytes], windows: np.ndarray, length: int = LENGTH):
        self.length, self.pad = length, length + 8
        sizes = np.array([len(c) for c in contents], np.int64)
        room = sizes + self.pad
        self.begin = np.cumsum(room) - room
        self.string = np.repeat(np.arange(len(room), dtype=np.int32), room)
        joined = np.frombuffer(b"".join(c + bytes(self.pad) for c in contents), np.uint8)
        inside = np.zeros(len(joined) + 1, np.int8)
        np.add.at(inside, self.begin, 1)
        np.add.at(inside, self.begin + sizes, -1)
        #: Bytes raised by one, 0 past the end; UTF-8 has no byte 255.
        self.data = joined + np.cumsum(inside[:-1]).astype(np.uint8)
        self.end = self.begin + sizes
        self.order = self._two_stages(windows)
        owner = self.string[self.order]
        wanted = self.order < (self.begin + windows)[owner]
        #: Window starts in sorted order, the string of each, and its place in the string.
        self.starts, self.owner = self.order[wanted], owner[wanted]
        self.offset = self.starts - self.begin[self.owner]

    def _two_stages(self, windows: np.ndarray) -> np.ndarray:
        data, n = self.data, len(self.data)
        # a suffix is smaller than its successor if the next different byte is larger
        change = np.append(np.flatnonzero(data[:-1] != data[1:]), n - 1)
        turn = np.repeat(change, np.diff(change, prepend=-1))
        small = np.zeros(n, bool)
        small[:-1] = data[turn[:-1]] < data[np.minimum(turn[:-1] + 1, n - 1)]
        small[self.end] = True  # the end of a string is smaller than all
        # wanted places, and on from the last one to the first place that is sorted directly
        next_small = np.flatnonzero(small)
        stop = next_small[np.searchsorted(next_small, self.begin + windows - 1)]
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, self.begin, 1)
        np.add.at(mark, stop + 1, -1)
        used = np.cumsum(mark[:-1]) > 0

        direct = np.flatnonzero(used & small)
        view = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(self.pad, np.uint8)), self.pad)
        keys = np.ascontiguousarray(view[direct]).view(f"S{self.pad}").ravel()
        direct = direct[np.argsort(keys, kind="stable")]
        by_first = np.searchsorted(data[direct], np.arange(258))
        larger = [[] for _ in range(257)]
        out = []

        def induce(batch: np.ndarray) -> None:
            before = batch[batch > 0] - 1
            before = before[used[before] & ~small[before]]
            letters = data[before]
            before = before[np.argsort(letters, kind="stable")]
            edges = np.searchsorted(data[before], np.arange(258))
            for c in np.flatnonzero(np.diff(edges)):
                larger[c].append(before[edges[c]:edges[c + 1]])

        for c in range(257):
            while larger[c]:  # scanning may add to the bucket that it scans
                batch, larger[c] = np.concatenate(larger[c]), []
                out.append(batch)
                induce(batch)
            batch = direct[by_first[c]:by_first[c + 1]]
            if len(batch):
                out.append(batch)
                induce(batch)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def common_prefixes(self) -> np.ndarray:
        """Common prefix of each window with the one before it, ``length`` at most; 0 for the first."""
        out = np.zeros(len(self.starts), np.int64)
        if len(out) > 1:
            heads = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[self.starts]
            same = heads[1:] == heads[:-1]
            out[1:] = np.where(same.all(axis=1), self.length, same.argmin(axis=1))
        return out


def smallest_documents(contents: list[bytes], windows: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each string, one string after the other, the smallest document that has the window."""
    suffixes = Suffixes(contents, windows, length)
    out = np.zeros(int(windows.sum()), np.int64)
    if len(suffixes.starts):
        heads = np.flatnonzero(suffixes.common_prefixes() < length)
        least = np.minimum.reduceat(docs[suffixes.owner], heads)
        sizes = np.diff(np.append(heads, len(suffixes.starts)))
        base = np.cumsum(windows) - windows
        out[base[suffixes.owner] + suffixes.offset] = np.repeat(least, sizes)
    return out


def _sorted_buckets(strings: DataFrame, carried: list[str], length: int) -> DataFrame:
    """Adds ``firsts`` (smallest document of each window, one number if all are equal) to strings grouped by ``bucket``."""
    kinds = ", ".join(f"{c} {strings.schema[c].dataType.simpleString()}" for c in carried)

    def kernel(group: pa.Table) -> pa.Table:
        windows = group.column("windows").to_numpy()
        firsts = smallest_documents(group.column("content").to_pylist(), windows, group.column("doc").to_numpy(), length)
        base = np.cumsum(windows) - windows
        one = np.minimum.reduceat(firsts, base) == np.maximum.reduceat(firsts, base)
        kept = ~np.repeat(one, windows)
        kept[base] = True
        edges = np.append(0, np.cumsum(np.where(one, 1, windows))).astype(np.int32)
        return pa.table({**{c: group.column(c) for c in carried}, "firsts": pa.ListArray.from_arrays(edges, firsts[kept])})

    return strings.groupBy("bucket").applyInArrow(kernel, f"{kinds}, firsts array<long>")


def first_documents(found: DataFrame, length: int) -> DataFrame:
    """(k1, k2, firsts): for every distinct segment the smallest document of each of its windows."""
    once = found.where(F.col("content").isNotNull()).groupBy("k1", "k2", "anchor").agg(F.min("doc").alias("doc"), F.first("windows").alias("windows"), F.first("content").alias("content"))
    once = stored(once, "distinct-segments")
    buckets = max(1, -(-once.count() // BUCKET_SEGMENTS))
    hot = stored(once.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_SEGMENTS).select("anchor"), "hot-anchors")
    cool = once.join(hot, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    out = _sorted_buckets(cool, ["k1", "k2"], length)
    if hot.isEmpty():
        return out
    # the windows of an anchor with very many segments go their own ways
    single = once.join(hot, "anchor", "left_semi").select("k1", "k2", "doc", F.explode(F.sequence(F.lit(0), F.col("windows").cast("int") - 1)).alias("offset"), "content")
    single = single.select("k1", "k2", "doc", "offset", F.expr(f"substring(content, offset + 1, {length})").alias("content"))
    window = single.groupBy("content").agg(F.min("doc").alias("doc")).withColumns({"windows": F.lit(1).cast("long"), "bucket": F.pmod(F.xxhash64("content"), F.lit(buckets))})
    window = _sorted_buckets(window, ["content"], length)
    placed = single.select("k1", "k2", "offset", "content").join(window, "content")
    again = placed.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("offset", F.col("firsts")[0].alias("first")))).alias("f"))
    return out.unionByName(again.select("k1", "k2", F.col("f.first").alias("firsts")))


# ---- removal -------------------------------------------------------------------------------------------------------

def _later_windows(found: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """(block, text, start, stop): stretches of texts covered by windows that an earlier document has."""
    def kernel(batches):
        for batch in batches:
            n = batch.column("windows").to_numpy()
            lists = batch.column("firsts")
            flat, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            edges = edges - edges[0]
            one = np.diff(edges) == 1
            places = np.repeat(edges[:-1], n) + np.where(np.repeat(one, n), 0, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            late = flat[places] < np.repeat(batch.column("doc").to_numpy(), n)
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new = late.copy()
            new[1:] &= ~late[:-1] | (row[1:] != row[:-1])
            end = late.copy()
            end[:-1] &= ~late[1:] | (row[1:] != row[:-1])
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            start = batch.column("start").to_numpy()
            yield {"block": batch.column("block").to_numpy()[row[a]], "text": batch.column("text").to_numpy()[row[a]],
                   "start": start[row[a]] + offset[a], "stop": start[row[b]] + offset[b] + length}

    rows = found.drop("content", "anchor").join(firsts, ["k1", "k2"]).select("block", "text", "doc", "start", "windows", "firsts")
    return map_batches(rows, kernel, "block long, text long, start long, stop long")


def _cut_texts(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, n_bytes, doc, spans, kept): merged removed runs of every distinct text and what is left of it."""
    def kernel(block: Block, answers: pa.Table) -> dict:
        text, start, stop = (answers.column(c).to_numpy() for c in ("text", "start", "stop"))
        order = np.lexsort((start, text))
        text, start, stop = text[order], start[order], stop[order]
        edges = np.searchsorted(text, np.arange(len(block.ids) + 1))
        runs, kept = [], []
        for k in range(len(block.ids)):
            own = slice(edges[k], edges[k + 1])
            a, upto = start[own], np.maximum.accumulate(stop[own])
            head = np.ones(len(a), bool)
            head[1:] = a[1:] > upto[:-1]
            tail = np.append(head[1:], True)[:len(a)]
            runs.append([{"start": int(x), "stop": int(y)} for x, y in zip(a[head], upto[tail])])
            raw, at, left = block.text(k), 0, []
            for run in runs[-1]:
                left.append(raw[at:run["start"]])
                at = run["stop"]
            kept.append(b"".join([*left, raw[at:]]))
        return {"digest": block.digests, "doc": block.ids, "n_bytes": np.diff(block.cut) - 1, "spans": runs, "kept": kept}

    return with_answers(blocks, spans, kernel, "digest string, doc long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(digest, doc, n_bytes, spans, kept) of every distinct text, judged as the text of its smallest document.

    A text is UTF-8 bytes (null: empty). ``spans`` are the maximal runs of bytes that lie in a window which also starts
    in a document with a smaller key; ``kept`` is what is left. Matches never cross texts. Rows without a key come
    after all others and not before one another.
    """
    blocks = pack_blocks(distinct_texts(docs, key, text))

    def late() -> DataFrame:
        found = shared_segments(blocks, length, anchor)
        firsts = stored_alone(lambda: first_documents(found, length), "first-documents")
        return _later_windows(found, firsts, length)

    return _cut_texts(blocks, stored_alone(late, "late-windows"))


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256.

    A copy of an earlier document's whole text loses everything, if it is at least ``length`` bytes long. Rows that
    repeat the smallest key of their text, or have no key like it, keep what that text keeps. Other columns are not read.
    """
    cut = remove_repeats(docs, key, text, length)
    sizes = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    cut = cut.select("digest", "doc", "n_bytes", sizes.alias("removed"), F.size("spans").cast("long").alias("runs"), F.sha2("kept", 256).alias("sha"))
    rows = docs.select(F.col(key).alias("_key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"))
    out = rows.join(cut, "digest")
    copy = (F.coalesce(F.col("_key").cast("long"), F.lit(NO_KEY)) > F.col("doc")) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_key").alias(key), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("removed")).alias("n_removed"),
                      F.when(copy, F.lit(1).cast("long")).otherwise(F.col("runs")).alias("n_spans"), F.when(copy, F.lit(nothing)).otherwise(F.col("sha")).alias("kept_sha256"))
