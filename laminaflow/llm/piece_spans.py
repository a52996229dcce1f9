"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

Normalisation is done here: at each place the longest key of the compiled character map (a double-array trie followed by
its replacement strings, as the model file stores it) is replaced, and for every normalised byte the original byte it
came from is recorded. White space handling follows the model's settings. The library then merges the normalised text
into pieces, and each piece is projected through the alignment to a byte span of the original text.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from laminaflow.llm.tables import map_batches, texts_of
from laminaflow.llm.units import Remembered, distinct_units, gathered

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
CACHED_UNITS = 300_000
#: Words merged in one call of the library.
JOINED_WORDS = 1000


class CharacterMap:
    """Longest-prefix replacement through the compiled map of a model."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken at ``at`` and their replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units) or units[node] & 0x800000FF != raw[k]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1]:end]


def char_size(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class SpanEncoder:
    """Encoder of one model; use one per task."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(model_file, "rb") as f:
            proto = model_pb2.ModelProto.FromString(f.read())
        self.spec = proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.pieces = [p.piece.encode() for p in proto.pieces]
        self.byte_pieces = [p.type == model_pb2.ModelProto.SentencePiece.BYTE for p in proto.pieces]
        own = model_pb2.ModelProto.FromString(proto.SerializeToString())
        own.normalizer_spec.CopyFrom(model_pb2.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        #: Merges text that is normalised already.
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=own.SerializeToString())
        self.sizes = np.array([1 if b else len(p) for p, b in zip(self.pieces, self.byte_pieces)], np.int32)
        self.marked = np.array([p.startswith(SPACE_BYTES) for p in self.pieces])
        # with no piece that runs over a word's start, words are merged alike alone and in place
        self.by_word = not self.suffix and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces) and not any(p.type == 4 for p in proto.pieces)
        # texts are cut into words before they are normalised, where that changes spaces only
        self.cut_first = (self.by_word and not self.map.units and self.spec.escape_whitespaces and self.spec.add_dummy_prefix
                          and not self.spec.remove_extra_whitespaces and SPACE_BYTES in self.pieces)
        #: Bytes of the original text that a piece stands for, where its marks are spaces.
        self.source_sizes = np.array([1 if b else len(p) - 2 * p.count(SPACE_BYTES) for p, b in zip(self.pieces, self.byte_pieces)], np.int32)
        #: Ids of a word with the spaces before it.
        self.known = Remembered(self._merge_units, CACHED_UNITS)

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for the end, the offset of the original byte it came from."""
        spec, raw = self.spec, text.encode()
        space = SPACE_BYTES if spec.escape_whitespaces else b" "
        if not self.map.units and not spec.remove_extra_whitespaces and raw:
            return self._plain(raw, space)
        out, align, at, blank = bytearray(), [], 0, spec.remove_extra_whitespaces
        if raw and spec.remove_extra_whitespaces:
            while at < len(raw):  # leading white space goes
                size, chunk = self._step(raw, at)
                if chunk != b" ":
                    break
                at += size
        if at < len(raw) and spec.add_dummy_prefix and not self.suffix:
            out += space
            align += [at] * len(space)
        while at < len(raw):
            size, chunk = self._step(raw, at)
            if blank:
                chunk = chunk.lstrip(b" ")
            for byte in chunk:
                new = space if byte == 32 else bytes([byte])
                out += new
                align += [at] * len(new)
            if chunk and spec.remove_extra_whitespaces:
                blank = chunk.endswith(b" ")
            at += size
        if spec.remove_extra_whitespaces:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space):], align[-len(space):]
        if raw and self.suffix and spec.add_dummy_prefix:
            out += space
            align += [at] * len(space)
        return bytes(out), np.array([*align, at], np.int32)

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        if found := self.map.longest(raw, at):
            return found
        size = char_size(raw[at])
        return size, raw[at:at + size]

    def _plain(self, raw: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no squeezing: only spaces change, and the alignment is a running sum."""
        lead = len(space) if self.spec.add_dummy_prefix and not self.suffix else 0
        tail = len(space) if self.spec.add_dummy_prefix and self.suffix else 0
        grown = np.where(np.frombuffer(raw, np.uint8) == 32, len(space), 1)
        align = np.concatenate([np.zeros(lead, np.int32), np.repeat(np.arange(len(raw), dtype=np.int32), grown), np.full(tail + 1, len(raw), np.int32)])
        return (space if lead else b"") + raw.replace(b" ", space) + (space if tail else b""), align

    def _merge(self, normal: str) -> np.ndarray:
        return np.array(self.merger.encode(normal, num_threads=1), "<i4")

    def _merge_joined(self, words: list[str]) -> list[bytes]:
        """Ids of words without marks in them, merged in one go; each begins with the piece that has its mark."""
        if not words:
            return []
        ids = self._merge("".join(SPACE + w for w in words))
        raw, cut = ids.tobytes(), (4 * np.append(np.flatnonzero(self.marked[ids]), len(ids))).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _merge_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of units, each some spaces and then a word, which may be empty."""
        words = b"\0".join(units).decode().replace(" ", SPACE).split("\0") if b"\0" not in b"".join(units) else [u.decode().replace(" ", SPACE) for u in units]
        plain = [k for k, w in enumerate(words) if len(w) > 1 and w.count(SPACE) == 1]
        out: list[bytes] = [b""] * len(words)
        for at in range(0, len(plain), JOINED_WORDS):
            some = plain[at:at + JOINED_WORDS]
            for k, ids in zip(some, self._merge_joined([words[k][1:] for k in some])):
                out[k] = ids
        return [found or self._merge(w).tobytes() for found, w in zip(out, words)]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each text has, and what ``encode`` gives for all of them, one text after the other."""
        able = [t for t in texts if t and SPACE not in t] if self.cut_first else []
        rows = [None if t and SPACE not in t and self.cut_first else self.encode(t) for t in texts]
        if able:
            raw = [t.encode() for t in able]
            data = b" " + b" ".join(raw)  # with the leading mark of each text as a space
            begin = np.cumsum([0, *[len(r) + 1 for r in raw]])
            blank = np.frombuffer(data, np.uint8) == 32
            new = blank.copy()
            new[1:] &= ~blank[:-1]
            new[begin[:-1]] = True
            starts = np.flatnonzero(new)
            units, which = distinct_units(data, starts)
            ids, n = gathered(self.known.ids(units), which)
            cut = np.append(0, np.cumsum(n))[np.searchsorted(starts, begin)]
            if (ids == 0).any():  # unknown without byte pieces
                done = iter([self.encode(t) for t in able])
            else:
                sizes = self.source_sizes[ids]
                ends = np.cumsum(sizes, dtype=np.int32) - np.repeat(begin[:-1].astype(np.int32) + 1, np.diff(cut))
                first, ends = np.maximum(ends - sizes, 0), np.maximum(ends, 0)
                if len(able) == len(texts):
                    return np.diff(cut), ids, first, ends
                done = iter([(ids[a:b], first[a:b], ends[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())])
            rows = [next(done) if r is None else r for r in rows]
        return np.array([len(r[0]) for r in rows], np.int64), *[np.concatenate([np.empty(0, np.int32), *[r[k] for r in rows]]) for k in range(3)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the end byte of the original text for each.

        A piece that stands for something the normaliser added (the leading mark) has the empty span at its place. The
        byte pieces of one unknown character each have their own byte where normalisation left it as it was.
        """
        if not text:
            none = np.empty(0, np.int32)
            return none, none, none
        normal, align = self.normalize(text)
        ids = self._merge(normal.decode())
        sizes = self.sizes[ids]
        if 0 in ids:  # unknown without byte pieces: as long as what its neighbours leave
            sizes = self._sizes_with_unknown(normal, ids)
        upto = np.cumsum(sizes)
        return ids, align[upto - sizes], align[upto]

    def _sizes_with_unknown(self, normal: bytes, ids: np.ndarray) -> np.ndarray:
        spans = self.merger.encode(normal.decode(), out_type="immutable_proto")
        return np.array([len(p.surface.encode()) for p in spans.pieces], np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.lru_cache(maxsize=1)
def span_encoder(model_file: str) -> SpanEncoder:
    """The encoder of a worker process, with what it remembers."""
    return SpanEncoder(model_file)


def encode_pieces(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ids array<int>, starts array<int>, ends array<int> (UTF-8 byte spans of the text).

    Null and empty texts have empty arrays. Null keys and repeated rows pass through; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = span_encoder(model_file)
        for batch in batches:
            n, *found = encoder.encode_many(texts_of(batch, "_text"))
            cut = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            yield {key: batch.column("_key"), **{name: pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32, copy=False))) for name, x in zip(("ids", "starts", "ends"), found)}}

    return map_batches(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), kernel, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(rows: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from the ids (null ids: null); all other columns stay."""
    schema = rows.schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            lists = batch.column(at)
            flat, cut = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            texts = [None if not there else library.decode(flat[a:b].tolist()) if b > a else "" for a, b, there in zip(cut, cut[1:], lists.is_valid().to_pylist())]
            yield {f.name: batch.column(k) for k, f in enumerate(schema.fields)} | {into: texts}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return map_batches(rows, kernel, f"{fields}, `{into}` string")
