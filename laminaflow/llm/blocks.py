"""Distinct texts packed into blocks, and corpus-wide counts of the 64-bit features of each block.

A block is one row with some hundred texts, so that tasks work on whole numpy arrays. Counts are exchanged in two hops:
each block sends its sorted distinct features, scattered over buckets (features may crowd anywhere, as
minimisers do at the low end); each bucket adds up what all blocks sent and answers with the totals in the same order. A feature crosses the network once per block, however often it
occurs in it, and a frequent feature weighs no more than a rare one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from laminaflow.llm.tables import as_arrow, map_batches, release, stored

BLOCK_BYTES = 1 << 20
#: Features that one bucket adds up; the number of buckets follows the input.
BUCKET_FEATURES = 1 << 20
#: Stands for a missing key; larger than every key.
NO_KEY = 1 << 62
BLOCK_SCHEMA = "block long, size long, ids array<long>, digests array<string>, cut array<long>, data binary"


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, text): every text once with the smallest key that has it; null is the empty text."""
    body = F.coalesce(F.col(text), F.lit(""))
    once = docs.select(F.col(key).cast("long").alias("k"), body.alias("text")).groupBy("text").agg(F.min("k").alias("k"))
    return once.select(F.coalesce("k", F.lit(NO_KEY)).alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")


def pack_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole texts, each text followed by a line end; written once, so numbers stay.

    A block's number is that of its first text; every text has a number of its own.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, digests, parts, size, number = [], [], [], 0, TaskContext.get().partitionId() << 36

        def close() -> dict:
            cut = np.cumsum([0, *[len(p) + 1 for p in parts]])
            return {"block": [number], "size": [size], "ids": [list(ids)], "digests": [list(digests)], "cut": [cut.tolist()], "data": [b"\n".join(parts) + b"\n"]}

        for batch in batches:
            for i, d, t in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                raw = t.encode()
                if parts and size + len(raw) > block_bytes:
                    yield close()
                    number += len(parts)
                    ids, digests, parts, size = [], [], [], 0
                ids.append(i), digests.append(d), parts.append(raw)
                size += len(raw) + 1
        if parts:
            yield close()

    return stored(map_batches(texts, kernel, BLOCK_SCHEMA), "blocks")


class Block:
    """One row of the block table."""

    def __init__(self, row: dict):
        self.number, self.ids, self.digests = row["block"], np.array(row["ids"], np.int64), row["digests"]
        self.cut = np.array(row["cut"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.texts = self.number + np.arange(len(self.ids))

    def text(self, k: int) -> bytes:
        return self.data[self.cut[k]:self.cut[k + 1] - 1].tobytes()


def blocks_of(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for k in range(batch.num_rows):
        yield Block({n: batch.column(n)[k].as_py() for n in ("block", "ids", "digests", "cut", "data")})


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of rising weight, which compresses well."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), 8).T).tobytes(), 1)


def _expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def scattered(features: np.ndarray) -> np.ndarray:
    """Features one to one as evenly spread numbers, by which they are sorted and dealt into buckets."""
    return mix(features ^ np.uint64(0x9E3779B97F4A7C15))


def feature_totals(blocks: DataFrame, features: Callable[[Block], tuple[np.ndarray, np.ndarray]], per_byte: float) -> DataFrame:
    """(block, bucket, totals) for the sorted distinct features of every block, their counts over all blocks.

    ``features`` gives a block's sorted distinct features and how many of its texts have each; ``per_byte`` is about how
    many features a byte of text has.
    """
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1.0, size * per_byte / BUCKET_FEATURES)))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for block in blocks_of(batch):
                found, counts = features(block)
                spread = scattered(found)
                order = np.argsort(spread)
                spread, counts = spread[order], counts[order]
                edges = np.searchsorted(spread >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(edges))
                cuts = [slice(edges[b], edges[b + 1]) for b in some]
                yield {"bucket": some.astype(np.int32), "block": [block.number] * len(some), "features": [_squeeze(spread[c]) for c in cuts],
                       "counts": [zlib.compress(counts[c].astype("<u4").tobytes(), 1) for c in cuts]}

    def add_up(group: pa.Table) -> pa.Table:
        parts = [_expand(x) for x in group.column("features").to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for x in group.column("counts").to_pylist()])
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(place, weights=counts).astype(np.uint32)[place]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        release()
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "totals": pa.array([zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(totals, ends)], pa.binary())})

    sent = map_batches(blocks.select("block", "ids", "digests", "cut", "data"), send, "bucket int, block long, features binary, counts binary")
    return stored(sent.groupBy("bucket").applyInArrow(add_up, "block long, bucket int, totals binary"), "feature-totals")


def totals_of(answers: pa.Table, features: np.ndarray) -> np.ndarray:
    """A block's answers in the order of its features."""
    order = np.argsort(answers.column("bucket").to_numpy())
    raw = answers.column("totals").to_pylist()
    out = np.empty(len(features), np.uint32)
    out[np.argsort(scattered(features))] = np.concatenate([np.frombuffer(zlib.decompress(raw[k]), "<u4") for k in order]) if raw else np.empty(0, np.uint32)
    return out


def with_answers(blocks: DataFrame, answers: DataFrame, kernel: Callable[[Block, pa.Table], dict], schema: str) -> DataFrame:
    """Runs ``kernel`` on every block together with the rows of ``answers`` for it (maybe none)."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [kernel(block, right) for block in blocks_of(left)]
        return pa.concat_tables([pa.table([as_arrow(p[f.name], f.type) for f in fields], schema=fields) for p in parts]) if parts else fields.empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


class Polynomial:
    """Hashes of any stretch of bytes from one pass over them: sums of table[byte] * base^place modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**60)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)

    def _powers(self, of: int, n: int) -> np.ndarray:
        out = np.full(n, of, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out, out=out)

    def prepare(self, data: np.ndarray) -> None:
        n = len(data) + 1
        self.shift = self._powers(self.base, n)
        self.sums = np.zeros(n, np.uint64)
        np.multiply(self.table[data], self.shift[:-1], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        self.shift = self._powers(self.inverse, n)

    def forget(self) -> None:
        """Frees what ``prepare`` made."""
        del self.sums, self.shift

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.shift[start] + (stop - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of a public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
