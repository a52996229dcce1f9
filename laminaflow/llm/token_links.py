"""Tokens of two tokenizers over the same bytes: the groups in which both cut alike, and the links between them.

Every token points to the farthest-right token that overlaps it (a token of the other side, or the token itself), and
doubling of these pointers takes every token to the last one of its component after as many rounds as the longest chain
has binary digits. That last token is the label of the group. All tokens of a block of texts are labelled at once.

Corpus-wide counts of linked id pairs are exchanged per block: a block sends each distinct pair once, cut into buckets
by its B id, and gets back the pair's count and whether no other A id has a higher one with that B id.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from laminaflow.llm.blocks import mix
from laminaflow.llm.tables import map_batches, stored, texts_of

SPACE = "▁"
#: Bytes of text that one block of the tables holds, but for a single longer text.
BLOCK_BYTES = 2 << 20
#: Stretches that a worker remembers, some 400 bytes each.
CACHED_UNITS = 300_000
#: Distinct pairs of blocks that one bucket adds up; the number of buckets follows the input.
BUCKET_PAIRS = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


class Aligner:
    """Both tokenizers with the byte strings of their entries; use one per task."""

    def __init__(self, byte_model: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.bytewise = Tokenizer.from_file(byte_model)
        self.bytewise.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        alphabet = byte_alphabet()
        entries = self.bytewise.get_vocab()
        special = {t.content for t in self.bytewise.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = entry.encode() if entry in special else bytes(map(alphabet.__getitem__, entry))
        self.b_bytes = [piece_bytes(self.pieces.id_to_piece(k)) for k in range(self.pieces.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for texts that are empty or that a side doesn't spell byte by byte."""
        full = [k for k, t in enumerate(texts) if t]
        none = np.empty(0, np.int32)
        a, b = [none] * len(texts), [none] * len(texts)
        left = self.bytewise.encode_batch_fast([" " + texts[k] for k in full], add_special_tokens=False)
        right = self.pieces.encode([texts[k] for k in full], num_threads=1)
        for k, x, y in zip(full, left, right):
            wanted, ids = (" " + texts[k]).encode(), x.ids
            if b"".join(map(self.a_bytes.__getitem__, ids)) == wanted and b"".join(map(self.b_bytes.__getitem__, y)) == wanted:
                a[k], b[k] = np.array(ids, np.int32), np.array(y, np.int32)
        return a, b


def farthest_overlap(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For all A tokens, then all B tokens: the farthest-right token overlapping it, itself if none goes farther.

    Tokens are byte ranges that follow one another without gaps from 0 on. Of two that end together A's is the farther.
    """
    n = len(a_ends)
    # the B token that holds the last byte of each A token, and the other way round
    over_b, over_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    a_next = np.where(b_ends[over_b] > a_ends, n + over_b, np.arange(n))
    b_next = np.where(a_ends[over_a] >= b_ends, over_a, n + np.arange(len(b_ends)))
    return np.concatenate([a_next, b_next])


def terminal_tokens(following: np.ndarray) -> np.ndarray:
    """Where every token's pointers lead, by doubling them until none moves."""
    while True:
        twice = following[following]
        if np.array_equal(twice, following):
            return following
        following = twice


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 on, of all A and all B tokens over the same bytes."""
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = terminal_tokens(farthest_overlap(a_ends, b_ends))
    n = len(a_ends)
    # the last token of a group is A's, as both sides end together there; A's tokens come in order
    number = np.cumsum(np.bincount(last[:n], minlength=n) > 0) - 1
    return number[last[:n]], number[last[n:]]


class Labelled:
    """Labelled tokens of a list of texts: ids, ends and groups of both sides, and where each text begins in them."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        a, b = aligner.tokens(texts)
        self.a_cut, self.b_cut = (np.cumsum([0, *map(len, side)]) for side in (a, b))
        self.a, self.b = (np.concatenate([*side, np.empty(0, np.int32)]) for side in (a, b))
        self.a_ends, self.b_ends = np.cumsum(aligner.a_sizes[self.a]), np.cumsum(aligner.b_sizes[self.b])
        # both sides of a text end together, so no group reaches over two texts
        self.a_group, self.b_group = groups_of(self.a_ends, self.b_ends)
        #: Last token of every group on each side: the linked pairs.
        self.a_last, self.b_last = (np.flatnonzero(np.append(g[1:] != g[:-1], True)[:len(g)]) for g in (self.a_group, self.b_group))
        self.cut = np.searchsorted(self.a_last, self.a_cut)

    def pairs(self) -> np.ndarray:
        return self.b[self.b_last].astype(np.int64) << 32 | self.a[self.a_last]


def written_groups(found: Labelled) -> list[str]:
    """``a1,a2|b1`` of every group, in order."""
    a, b = list(map(str, found.a.tolist())), list(map(str, found.b.tolist()))
    a_at, b_at = (np.concatenate([[0], last + 1]).tolist() for last in (found.a_last, found.b_last))
    return [f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:])]


class Units:
    """Aligned stretches of text, remembered.

    Both tokenizers cut before a single space between two other characters, whatever stands around it: the pre-tokenizer
    of A starts a word there, and no piece of B has a space mark behind another character. So a text is split there, and
    each stretch is encoded and labelled once for as long as it is remembered.
    """

    INNER = regex.compile(r"(?<=\S) (?=\S)")
    EDGE = regex.compile(r"^\s|\s$")

    def __init__(self, byte_model: str, piece_model: str):
        self.aligner = Aligner(byte_model, piece_model)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in map(self.aligner.pieces.id_to_piece, range(self.aligner.pieces.get_piece_size())))
        #: Per stretch: A tokens, B tokens, written groups, linked pairs; none where a side doesn't spell it.
        self.known: dict[str, tuple[int, int, str, bytes] | None] = {}

    def _learn(self, units: list[str]) -> None:
        joined = [u for u in units if u and SPACE not in u and not self.EDGE.search(u)]
        alone = list(set(units).difference(joined))
        found = Labelled(self.aligner, [" ".join(joined), *alone])
        if joined and not found.cut[1]:  # not spelled: then one by one
            joined, alone = [], units
            found = Labelled(self.aligner, ["", *alone])
        ends = np.cumsum([1 + len(u.encode()) for u in joined])
        upto = [np.searchsorted(e, ends, "right") for e in (found.a_ends[:found.a_cut[1]], found.b_ends[:found.b_cut[1]])]
        a_cut, b_cut = (np.concatenate([[0], u, c[2:]]) for u, c in zip(upto, (found.a_cut, found.b_cut)))
        cut = np.searchsorted(found.a_last, a_cut).tolist()
        groups, pairs = written_groups(found), found.pairs().astype("<i8").tobytes()
        for unit, n_a, n_b, i, j in zip([*joined, *alone], np.diff(a_cut).tolist(), np.diff(b_cut).tolist(), cut, cut[1:]):
            self.known[unit] = (n_a, n_b, ";".join(groups[i:j]), pairs[8 * i:8 * j]) if n_a else None

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, str, bytes]]:
        """(A tokens, B tokens, written groups, linked pairs) per text."""
        none = (0, 0, "", b"")
        split = [([] if not t else self.INNER.split(t) if self.splits else [t]) for t in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > CACHED_UNITS:
                self.known.clear()
                missing = wanted
            self._learn(list(missing))
        for units in split:
            found = list(map(self.known.__getitem__, units))
            if not found or None in found:
                yield none
            else:
                n_a, n_b, written, pairs = zip(*found)
                yield sum(n_a), sum(n_b), ";".join(written), b"".join(pairs)


@functools.lru_cache(maxsize=1)
def units_of(byte_model: str, piece_model: str) -> Units:
    """The remembered stretches of a worker process."""
    return Units(byte_model, piece_model)


def align_tokens(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, a_ids, b_ids, a_ends, b_ends (byte offsets in space + text), a_groups, b_groups.

    A is the byte-level tokenizer over space + text, B the piece model over the text. Groups are numbered from 0 in each
    text. Null and empty texts, and those whose tokens don't spell space + text, have empty arrays. Null keys and
    repeated rows pass through, an empty table gives an empty one, other columns are not read. Texts are whole, whatever
    their length: a task holds a batch's tokens.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ("a_ids", "b_ids", "a_ends", "b_ends", "a_groups", "b_groups")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        aligner = units_of(byte_model, piece_model).aligner
        for batch in batches:
            found = Labelled(aligner, texts_of(batch, "_text"))
            base = np.append(0, found.a_ends)[found.a_cut]
            out = {}
            for name, ids, ends, group, cut in (("a", found.a, found.a_ends, found.a_group, found.a_cut), ("b", found.b, found.b_ends, found.b_group, found.b_cut)):
                row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
                offsets = pa.array(cut, pa.int32())
                for part, values in ((f"{name}_ids", ids), (f"{name}_ends", ends - base[row]), (f"{name}_groups", group - found.cut[row])):
                    out[part] = pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
            yield {key: batch.column("_key"), **out}

    return map_batches(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), kernel, f"`{key}` {kind}, " + ", ".join(f"{n} array<int>" for n in names))


# ---- corpus-wide counts --------------------------------------------------------------------------------------------

BLOCK = ("block long, keys array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, links binary, pairs binary, counts binary, n_pairs long")


def _squeezed(values: np.ndarray, dtype: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(values.astype(dtype)).tobytes(), 1)


def _expanded(raw: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype)


def _blocks(docs: DataFrame, byte_model: str, piece_model: str, key: str, text: str) -> DataFrame:
    """Aligned texts by blocks: digests, and the links as places in the block's sorted distinct pairs."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        units, block = units_of(byte_model, piece_model), TaskContext.get().partitionId() << 36

        def close() -> dict:
            links = np.frombuffer(b"".join(linked), "<i8")
            pairs, place, counts = np.unique(links, return_inverse=True, return_counts=True)
            return {"block": [block], **{c: [v] for c, v in rows.items()}, "links": [_squeezed(place, "<u4")], "pairs": [_squeezed(pairs, "<i8")], "counts": [_squeezed(counts, "<i8")],
                    "n_pairs": [len(pairs)]}

        rows, linked, size = {c: [] for c in ("keys", "n_a", "n_b", "n_links", "groups_sha256")}, [], 0
        for batch in batches:
            texts = texts_of(batch, "_text")
            for k, t, (n_a, n_b, written, pairs) in zip(batch.column("_key").to_pylist(), texts, units.align(texts)):
                if rows["keys"] and size + len(t) > BLOCK_BYTES:
                    yield close()
                    rows, linked, size, block = {c: [] for c in rows}, [], 0, block + 1
                for values, value in zip(rows.values(), (k, n_a, n_b, len(pairs) // 8, hashlib.sha256(written.encode()).hexdigest() if written else "")):
                    values.append(value)
                linked.append(pairs)
                size += len(t)
        if rows["keys"]:
            yield close()

    return stored(map_batches(docs.select(docs[key].cast("long").alias("_key"), docs[text].alias("_text")), kernel, BLOCK), "token-links")


def _pair_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, totals, best): for the distinct pairs of every block, in their order within the bucket."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for number, raw, many in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
                pairs, counts = _expanded(raw, "<i8"), _expanded(many, "<i8")
                bucket = bucket_of(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                some, first = np.unique(bucket[order], return_index=True)
                parts = np.split(order, first[1:]) if len(some) else []
                yield {"bucket": some, "block": [number] * len(some), "pairs": [_squeezed(np.diff(pairs[p], prepend=0), "<i8") for p in parts],
                       "counts": [_squeezed(counts[p], "<i8") for p in parts]}

    def add_up(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(_expanded(x, "<i8")) for x in group.column("pairs").to_pylist()]
        counts = np.concatenate([_expanded(x, "<i8") for x in group.column("counts").to_pylist()])
        pairs, place = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, place, counts)
        # pairs are sorted by their B id, which all stand in this bucket
        first = np.flatnonzero(np.append(True, (pairs[1:] >> 32) != (pairs[:-1] >> 32)))
        highest = np.repeat(np.maximum.reduceat(totals, first), np.diff(np.append(first, len(pairs))))
        ends = np.cumsum([len(p) for p in parts])[:-1]
        split = lambda x, kind: pa.array([_squeezed(v, kind) for v in np.split(x[place], ends)], pa.binary())
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "totals": split(totals, "<i8"), "best": split(totals == highest, "u1")})

    sent = map_batches(blocks.select("block", "pairs", "counts"), send, "bucket long, block long, pairs binary, counts binary")
    return stored(sent.groupBy("bucket").applyInArrow(add_up, "block long, bucket long, totals binary, best binary"), "pair-counts")


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((pairs >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def link_counts(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of tokens that end together, the last ones of each group; its count is how many links of all rows
    join the same two ids. n_best counts the links whose count is the highest of their B id (ties too), count_sum adds up
    all. Rows without tokens (see ``align_tokens``) have zeros and an empty digest. Null keys and repeated rows each get
    their row, and repeated rows count each time. Other columns are not read.
    """
    blocks = _blocks(docs, byte_model, piece_model, key, text)
    buckets = max(16, -(-(blocks.agg(F.sum("n_pairs")).first()[0] or 0) // BUCKET_PAIRS))
    answers = _pair_counts(blocks, buckets)
    schema = "keys long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(right.column("bucket").to_numpy())
        totals, best = (np.concatenate([_expanded(right.column(c)[int(k)].as_py(), kind) for k in order] or [np.empty(0, kind)]) for c, kind in (("totals", "<i8"), ("best", "u1")))
        for row in left.to_pylist():
            pairs, links = _expanded(row["pairs"], "<i8"), _expanded(row["links"], "<u4")
            place = np.empty(len(pairs), np.int64)
            place[np.argsort(bucket_of(pairs, buckets), kind="stable")] = np.arange(len(pairs))
            cut = np.cumsum([0, *row["n_links"]])
            at = place[links]
            sums, bests = (np.append(0, np.cumsum(x[at], dtype=np.int64)) for x in (totals, best))
            out.append(pa.table([pa.array(v, f.type) for f, v in zip(fields, (row["keys"], row["n_a"], row["n_b"], row["n_links"], np.diff(bests[cut]), np.diff(sums[cut]), row["groups_sha256"]))], schema=fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    joined = blocks.drop("counts", "n_pairs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(kernel, schema)
    kind = docs.schema[key].dataType
    return joined.select(F.col("keys").cast(kind).alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
