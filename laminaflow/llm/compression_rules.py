"""Quality rules with compression bands.

A text is compressed as a whole and in fixed chunks with zstandard. Too high a ratio of raw to compressed bytes means
repetition, too low a ratio means noise (keys, hashes, encoded data). Short texts compress worse than long ones, so each
limit belongs to a range of lengths. The check of chunks finds a bad stretch that the whole text would hide: by the share
of bad chunks, and in long texts by the longest run of them. The last chunk ends with the text and overlaps the one before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from laminaflow.llm.tables import map_batches, texts_of

LEVEL = 3
CHUNK_BYTES = 2048
SYMBOLS = "#*$%&|<>"
#: Words are separated by these; bytes.split() splits at exactly these.
SEPARATORS = " \t\n\v\f\r"


@dataclass(frozen=True)
class Band:
    """Accepted ratios of texts with at least ``from_bytes`` bytes, up to the next band."""

    from_bytes: int
    lowest: float
    highest: float


#: Whole texts. Below 64 bytes the frame header dominates and nothing can be said.
WHOLE = (Band(0, 0.0, 1e9), Band(64, 0.8, 2.2), Band(256, 1.1, 2.6), Band(1024, 1.35, 3.2), Band(4096, 1.5, 3.8), Band(16384, 1.6, 4.6), Band(65536, 1.7, 5.6))
#: One chunk of CHUNK_BYTES.
CHUNK = Band(CHUNK_BYTES, 1.35, 3.4)
#: Largest share of a text's chunks outside the band, and the most of them in a row.
BAD_CHUNKS, BAD_RUN = 0.25, 2


def band_of(bands: Sequence[Band], n_bytes: int) -> Band:
    return max((b for b in bands if b.from_bytes <= n_bytes), key=lambda b: b.from_bytes)


def repeated_words(words: Sequence[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text, first occurrence included."""
    windows = list(zip(*[words[k:] for k in range(size)]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + size - max(at, upto)
            upto = at + size
    return covered


def longest_run(bad: Sequence[bool]) -> int:
    longest = run = 0
    for x in bad:
        run = run + 1 if x else 0
        longest = max(longest, run)
    return longest


def duplicate_lines(raw: bytes) -> int:
    """Lines with at least one word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\v\f\r")]
    return len(lines) - len(set(lines))


class Rules:
    """Scores one text; holds the compressor of a task."""

    def __init__(self, whole: Sequence[Band] = WHOLE, chunk: Band = CHUNK, bad_chunks: float = BAD_CHUNKS, bad_run: int = BAD_RUN):
        self.whole, self.chunk, self.bad_chunks, self.bad_run = whole, chunk, bad_chunks, bad_run
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.zstd.compress(raw))

    def score(self, text: str) -> dict:
        raw = text.encode()
        words = raw.split()
        repeated = repeated_words(words)
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        ratio = self.ratio(raw) if raw else None
        size, view = self.chunk.from_bytes, memoryview(raw)
        starts = [*range(0, len(raw) - size + 1, size)]
        if starts and len(raw) % size:
            starts.append(len(raw) - size)
        chunks = [self.ratio(view[at:at + size]) for at in starts]
        outside = [not self.chunk.lowest <= x <= self.chunk.highest for x in chunks]
        bad = sum(outside)
        band = band_of(self.whole, len(raw))
        good = ratio is not None and band.lowest <= ratio <= band.highest and bad <= self.bad_chunks * len(chunks) and longest_run(outside) <= self.bad_run
        return {
            "n_words": len(words), "word_chars": len(text) - sum(map(text.count, SEPARATORS)), "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": duplicate_lines(raw), "n_repeat_words": repeated, "base_failed": failed, "kept": good and not failed,
            "ratio": ratio, "n_chunks": len(chunks), "n_bad_chunks": bad,
        }


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def compression_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: Sequence[Band] = WHOLE,
                        chunk: Band = CHUNK, bad_chunks: float = BAD_CHUNKS, bad_run: int = BAD_RUN) -> DataFrame:
    """One row per row of ``docs``: key, counts, base verdict and the verdict of the compression bands.

    Null and empty texts have no words, so they fail the base rules and are not kept; their ratio is null. Null keys and
    repeated rows pass through. Only the two named columns are read. Texts are scored whole and one at a time, so memory
    is a few times the longest text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rules = Rules(whole, chunk, bad_chunks, bad_run)
        for batch in batches:
            rows = [rules.score(t) for t in texts_of(batch, "_text")]
            yield {key: batch.column("_key"), **{c: [r[c] for r in rows] for c in re.findall(r"(\w+) (?:long|boolean|double)", SCHEMA)}}

    return map_batches(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), kernel, f"`{key}` {kind}, {SCHEMA}")
