"""Token ids in fixed-width binary files.

Each id takes the fewest bits that hold every id of the vocabulary. A file holds whole documents in ascending order of
their key: a header, the ids in blocks of ``BLOCK_IDS`` (each block starts on a byte, so its offset in the file is known
and any block is unpacked alone), the block offsets, and a table of documents (key, first id, ids). Reading is vectorised.

    "LFBP" | u16 bits | u16 0 | u32 ids per block | u64 ids | u64 documents | u64 blocks        (little endian)
    blocks | u64 offset of each block | documents: i64 key, u8 key is null, u64 first id, u64 ids (column by column)

The writer range-sorts the documents, one task writes one run of files under temporary names, and a manifest that Spark
commits says which of them count; they get their final names only then, so lost or repeated tasks leave no trace.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laminaflow.llm.tables import discard, folder, make_folder, map_batches, stored, texts_of
from laminaflow.llm.units import Remembered, distinct_units, gathered

MAGIC, HEAD = b"LFBP", "<4sHHIQQQ"
BLOCK_IDS = 4096
FILE_IDS = 8 << 20
CACHED_UNITS = 600_000
#: Units encoded in one call of the library.
JOINED_UNITS = 1000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, lowest bit first, filled up with zeros to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``raw``."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Encodes with the tokenizers library; ids of a stretch between two inner spaces are remembered.

    The byte-level pre-tokenizer always starts a token at a single space between two other characters, so such stretches
    are encoded alike alone and in place; so are a comma or full stop after a letter or number and what precedes it.
    Texts with special tokens go to the library whole.
    """

    BLANKS = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
    WORDS = np.isin(np.arange(256), [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
    MARKS = np.isin(np.arange(256), [*b",."])
    #: First bytes of the characters beyond ASCII that are white space (and of others).
    WIDE_2, WIDE_3 = np.isin(np.arange(256), [0xC2]), np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Tokens that begin with a space, which the byte alphabet writes so.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[k for piece, k in self.tokenizer.get_vocab().items() if piece.startswith("\u0120")]] = True
        self.known = Remembered(self._units, CACHED_UNITS)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[bytes]) -> list[bytes]:
        """Ids of units. Those of a space and a word are encoded in one go; each begins with the token that has its space."""
        texts = [u.decode() for u in units]
        plain = [k for k, t in enumerate(texts) if t[0] == " " and t.split() == [t[1:]]]
        out: list[bytes] = [b""] * len(texts)
        for at in range(0, len(plain), JOINED_UNITS):
            some = plain[at:at + JOINED_UNITS]
            ids = np.frombuffer(self._library(["".join([texts[k] for k in some])])[0], "<u4")
            raw, cut = ids.tobytes(), (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            for k, a, b in zip(some, cut, cut[1:]):
                out[k] = raw[a:b]
        odd = [k for k, found in enumerate(out) if not found]
        for k, ids in zip(odd, self._library([texts[k] for k in odd])):
            out[k] = ids
        return out

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Where a new stretch begins at a space or mark; not where the byte before or after might be white space, or the mark's own token."""
        near = np.concatenate([np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)])
        space = near[3:-1] == 32
        space &= ~(self.BLANKS | self.WIDE_2 | self.WIDE_3)[near[4:]]
        space &= ~self.BLANKS[near[2:-2]]
        space &= ~(self.WIDE_2[near[1:-3]] | self.WIDE_3[near[:-4]])
        return space | (self.MARKS[data] & self.WORDS[near[2:-2]])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        out = [np.empty(0, "<u4")] * len(texts)
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        for k, ids in zip(whole, self._library([texts[k] for k in whole])):
            out[k] = np.frombuffer(ids, "<u4")
        able = sorted({k for k, t in enumerate(texts) if t}.difference(whole))
        if able:
            raw = [texts[k].encode() for k in able]
            data, begin = b"".join(raw), np.cumsum([0, *map(len, raw)])
            new = self._cuts(np.frombuffer(data, np.uint8))
            new[begin[:-1]] = True
            starts = np.flatnonzero(new)
            units, which = distinct_units(data, starts)
            ids, n = gathered(self.known.ids(units), which)
            cut = np.append(0, np.cumsum(n))[np.searchsorted(starts, begin)].tolist()
            for k, a, b in zip(able, cut, cut[1:]):
                out[k] = ids[a:b].view("<u4")
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process, with what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def file_bytes(ids: np.ndarray, keys: list[int | None], counts: list[int], bits: int) -> bytes:
    blocks = [pack(ids[at:at + BLOCK_IDS], bits) for at in range(0, len(ids), BLOCK_IDS)]
    head = struct.pack(HEAD, MAGIC, bits, 0, BLOCK_IDS, len(ids), len(keys), len(blocks))
    sizes = np.array([len(head), *map(len, blocks)], np.uint64)
    n = np.array(counts, "<u8")
    table = [np.array([k or 0 for k in keys], "<i8"), np.array([k is None for k in keys], "u1"), np.cumsum(n, dtype="<u8") - n, n]
    return b"".join([head, *blocks, np.cumsum(sizes)[:len(blocks)].astype("<u8").tobytes(), *[c.tobytes() for c in table]])


class PackedFile:
    """Random access to the ids of one file."""

    def __init__(self, raw: bytes | memoryview):
        self.raw = memoryview(raw)
        magic, self.bits, _, self.block, self.n_ids, self.n_docs, n_blocks = struct.unpack_from(HEAD, self.raw)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = len(self.raw) - 25 * self.n_docs - 8 * n_blocks
        self.offsets = np.frombuffer(self.raw, "<u8", n_blocks, at)
        at += 8 * n_blocks
        keys, at = np.frombuffer(self.raw, "<i8", self.n_docs, at), at + 8 * self.n_docs
        null, at = np.frombuffer(self.raw, "u1", self.n_docs, at), at + self.n_docs
        self.keys = [None if gone else int(k) for k, gone in zip(keys, null)]
        self.first = np.frombuffer(self.raw, "<u8", self.n_docs, at).astype(np.int64)
        self.count = np.frombuffer(self.raw, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file; unpacks only the blocks that hold them."""
        if not n:
            return np.empty(0, np.uint32)
        low, high = start // self.block, (start + n - 1) // self.block
        parts = []
        for k in range(low, high + 1):
            size = min(self.block, self.n_ids - k * self.block)
            at = int(self.offsets[k])
            parts.append(unpack(self.raw[at:at + (size * self.bits + 7) // 8], size, self.bits))
        return np.concatenate(parts)[start - low * self.block:][:n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.count[k]))


def put(base: str, name: str, data: bytes) -> None:
    fs, root = pafs.FileSystem.from_uri(base)
    fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(data)


def as_uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace(":/", ":///", 1)


def commit(spark: SparkSession, manifest: DataFrame, base: str) -> None:
    """Gives the files that the manifest names (columns temporary, name) their final names, on the executors."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        fs, root = pafs.FileSystem.from_uri(base)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for old, new in zip(batch.column("temporary").to_pylist(), names):
                if fs.get_file_info(f"{root}/{new}").type == pafs.FileType.NotFound:  # else an earlier attempt moved it
                    fs.move(f"{root}/{old}", f"{root}/{new}")
            yield {"name": names}

    make_folder(spark, base)
    map_batches(manifest.select("temporary", "name"), kernel, "name string").write.format("noop").mode("overwrite").save()
    discard(spark, f"{base}/_temporary")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                      base: str | None = None, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Writes every row of ``docs`` and returns the folder and its manifest.

    Manifest: shard, seq (file of the shard), name, n_docs, n_ids, bytes. Documents are ordered by (key, text), null keys
    first; null and empty texts become the end id alone; repeated rows are written as often as they occur. A file ends
    with the document that reaches ``file_ids``, so no task ever holds more than one file and one document.
    """
    spark = docs.sparkSession
    base = as_uri(base or folder(spark, "token-files"))
    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, attempt = encoder_of(tokenizer), uuid.uuid4().hex
        ids, keys, seq = [], [], 0

        def close(shard: int) -> dict:
            data = file_bytes(np.concatenate(ids), keys, [len(x) for x in ids], bits)
            name = f"part-{shard:06d}-{seq:05d}.ids"
            put(base, f"_temporary/{attempt}/{name}", data)
            out = {"shard": [shard], "seq": [seq], "name": [name], "temporary": [f"_temporary/{attempt}/{name}"], "n_docs": [len(keys)], "n_ids": [sum(map(len, ids))], "bytes": [len(data)]}
            ids.clear(), keys.clear()
            return out

        held, shard = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("_shard")[0].as_py()
            for k, found in zip(batch.column("_key").to_pylist(), encoder.encode_many(texts_of(batch, "_text"))):
                ids.append(np.append(found, np.uint32(end_id)))
                keys.append(k)
                held += len(ids[-1])
                if held >= file_ids:
                    yield close(shard)
                    held, seq = 0, seq + 1
        if keys:
            yield close(shard)

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    rows = rows.repartitionByRange("_key").sortWithinPartitions("_key", "_text").withColumn("_shard", F.spark_partition_id())
    manifest = stored(map_batches(rows, kernel, "shard int, seq int, name string, temporary string, n_docs long, n_ids long, bytes long"), "token-manifest")
    commit(spark, manifest, base)
    return base, manifest.drop("temporary")


def read_token_files(spark: SparkSession, base: str, manifest: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Per document in the files: key, start (ids of all documents before it), n_tokens, ids_crc32, and the ids."""
    place = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = manifest.select("name", F.coalesce(F.sum("n_ids").over(place), F.lit(0)).alias("before"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = PackedFile(content.as_buffer())
                for low in range(0, file.n_docs, 256):
                    high = min(low + 256, file.n_docs)
                    # a stretch of documents shares one unpacking
                    start, n = int(file.first[low]), int(file.count[low:high].sum())
                    flat = file.ids(start, n)
                    cut = np.append(file.first[low:high] - start, n)
                    own = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
                    out = {"name": [path.rsplit("/", 1)[1]] * len(own), key: file.keys[low:high], "first": file.first[low:high], "n_tokens": file.count[low:high],
                           "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in own]}
                    yield out | ({"ids": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))} if ids else {})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(base).select("path", "content")
    rows = map_batches(files, kernel, f"name string, `{key}` long, first long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    out = rows.join(before, "name")
    return out.select(key, (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
