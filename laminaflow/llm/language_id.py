"""Language identification with unigram pieces, summed over all segmentations.

The pieces come from a fixed public vocabulary; only their probability in each language is learned (a few rounds of
expectation maximisation over word counts). A word's probability is the sum over every way to cut it into pieces, found
by the forward algorithm; a text's is the product over its words. All words of a batch are worked on at once, place by
place, for all languages. The label is the most probable language, the score its posterior under equal priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminaflow.llm.tables import map_batches, stored, texts_of

#: Words are runs of letters, lower-cased, with a mark in front; longer runs are cut after so many letters.
LONGEST_WORD = 24
WORD = regex.compile(r"\p{L}{1,%d}" % LONGEST_WORD)
MARK = "▁"
CACHED_WORDS = 150_000
#: About so many distinct labelled texts of each language take part in the fit.
FIT_ROWS = 3000
ROUNDS = 3
#: A text is unlike its language if its loglik is below the median of the labelled texts by more than this, or by more than
#: TAIL times the distance to their lowest twentieth, plus SHORT standard deviations for its number of letters.
LEAST_DROP, TAIL, SHORT = 1.0, 4, 3


@dataclass
class Pieces:
    """The vocabulary as a sorted table of hashes; pieces of one to ``longest`` characters."""

    hashes: np.ndarray
    longest: int

    def __post_init__(self):
        self.n = len(self.hashes)
        #: Whether any piece's hash begins with these bits; most stretches of a word are no piece.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @classmethod
    def load(cls, model_file: str) -> "Pieces":
        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        own = {library.id_to_piece(k).lower() for k in range(library.get_piece_size()) if not (library.is_control(k) or library.is_byte(k) or library.is_unknown(k))}
        own = [p for p in own if WORD.fullmatch(p.removeprefix(MARK) or "a")]
        codes, mask = encode_words(own)
        lengths = mask.sum(axis=1)
        hashes = np.zeros(len(own), np.uint64)
        for size, spans in enumerate(span_hashes(codes, int(lengths.max())), 1):
            hashes[lengths == size] = spans[lengths == size, 0]
        return cls(np.unique(hashes), int(lengths.max()))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each piece; ``n`` where there is none."""
        out = np.full(hashes.shape, self.n, np.int32)
        some = self.maybe[hashes >> np.uint64(44)]
        wanted = hashes[some]
        at = np.minimum(np.searchsorted(self.hashes, wanted), self.n - 1)
        out[some] = np.where(self.hashes[at] == wanted, at, self.n)
        return out


def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in a matrix, a row for each word, and which cells are used."""
    lengths = np.array([len(w) for w in words])
    mask = np.arange(lengths.max(initial=1))[None, :] < lengths[:, None]
    codes = np.zeros(mask.shape, np.uint64)
    codes[mask] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, mask


def span_hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each size up to ``longest``: the hash of every stretch of that many characters of every row."""
    width, state = codes.shape[1], np.zeros_like(codes)
    for size in range(1, min(longest, width) + 1):
        state = state[:, :width - size + 1]
        state = (state ^ codes[:, size - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        yield state * np.uint64(2 * size + 1)


def word_units(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    pieces: Pieces
    languages: list[str]
    #: Probability of each piece in each language; the last row is for a character that no piece covers.
    table: np.ndarray

    def _lattice(self, words: list[str]):
        codes, mask = encode_words([MARK + w for w in words])
        lengths = mask.sum(axis=1)
        found = {size: self.pieces.find(spans) for size, spans in enumerate(span_hashes(codes, self.pieces.longest), 1)}
        return codes.shape[1], lengths, found

    def _weights(self, found: np.ndarray, size: int) -> np.ndarray:
        """Probabilities of the pieces found; one character alone always has some, a longer stretch needs a piece."""
        p = self.table[found]
        return p if size == 1 else np.where((found < self.pieces.n)[:, None], p, 0.0)

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        if not words:
            return np.zeros((0, len(self.languages)))
        width, lengths, found = self._lattice(words)
        alpha = self._alpha(width, len(words), found)
        return np.log(alpha[lengths, np.arange(len(words))] + 1e-300)

    def _alpha(self, width: int, n: int, found: dict[int, np.ndarray]) -> np.ndarray:
        alpha = np.zeros((width + 1, n, len(self.languages)))
        alpha[0] = 1.0
        for end in range(1, width + 1):
            for size in range(1, min(self.pieces.longest, end) + 1):
                alpha[end] += alpha[end - size] * self._weights(found[size][:, end - size], size)
        return alpha

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, words weighted by ``counts`` (word x language)."""
        total = np.zeros_like(self.table)
        width, lengths, found = self._lattice(words)
        alpha = self._alpha(width, len(words), found)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(words))
        for start in range(width, -1, -1):
            beta[start][lengths == start] = 1.0
            for size in range(1, min(self.pieces.longest, width - start) + 1):
                beta[start] += beta[start + size] * self._weights(found[size][:, start], size)
        scale = counts / np.maximum(alpha[lengths, rows], 1e-300)
        pieces, shares = [], []
        for size, at in found.items():
            for start in range(width - size + 1):
                some = np.flatnonzero((at[:, start] < self.pieces.n) | (size == 1))
                own = at[some, start]
                pieces.append(own)
                shares.append(alpha[start][some] * self.table[own] * beta[start + size][some] * scale[some])
        used, share = np.concatenate(pieces), np.concatenate(shares)
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(used, weights=share[:, k], minlength=len(total))
        return total


class Scorer:
    """Scores texts with remembered words; use one per task."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((1024, len(model.languages)))

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The words of the texts; those not known yet are scored together, short ones first."""
        units = [word_units(t) for t in texts]
        words = set().union(*units).difference(self.known)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            words = set().union(*units)
        words, at = sorted(words, key=lambda w: (len(w), w)), len(self.known)
        if at + len(words) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), at + len(words)), self.table.shape[1]))
            grown[:at] = self.table[:at]
            self.table = grown
        for k in range(0, len(words), 4096):
            self.table[at + k:at + k + 4096][:len(words[k:k + 4096])] = self.model.forward(words[k:k + 4096])
        self.known.update(zip(words, range(at, at + len(words))))
        return units

    def score(self, texts: list[str]) -> list[tuple[str, float, float | None, int]]:
        """Per text: language, posterior, log probability per letter in that language, and letters."""
        if not self.model.languages:
            return [("und", 0.0, None, 0)] * len(texts)
        return [self._posterior(words) if words else ("und", 0.0, None, 0) for words in self.learn(texts)]

    def _posterior(self, words: list[str]) -> tuple[str, float, float, int]:
        total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        best, letters = int(total.argmax()), sum(map(len, words))
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum()), float(total[best] / letters), letters


def fit(train: DataFrame, model_file: str, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Learns piece probabilities from labelled rows.

    A bounded sample is used: of each language about ``fit_rows`` distinct texts, those with the smallest hashes (all texts
    of a rarer language); copies count once. Rows without text or label don't count. Word counts stay in Spark; each round sends back
    only the sums for every piece and language. Without labelled rows the model has no language.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(text).alias("_hash"))
    sizes = {r._lang: r.n for r in rows.select("_lang", "_hash").distinct().groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages, pieces = sorted(sizes), Pieces.load(model_file)
    model = Model(pieces, languages, np.full((pieces.n + 1, len(languages)), 1.0 / (pieces.n + 1)))
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, fit_rows / sizes[k]))])[F.col("_lang")]
    sample = rows.where(F.pmod("_hash", F.lit(1 << 30)) < share * (1 << 30)).groupBy("_lang", "_hash").agg(F.first("_text").alias("_text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for t, k in zip(texts_of(batch, "_text"), batch.column("_lang").to_pylist()):
                counts.setdefault(k, Counter()).update(word_units(t))
            if sum(map(len, counts.values())) > CACHED_WORDS:
                yield from flush(counts)
        yield from flush(counts)

    def flush(counts: dict[str, Counter]) -> Iterator[dict]:
        for k, own in counts.items():
            yield {"lang": [k] * len(own), "word": list(own), "n": list(own.values())}
        counts.clear()

    words = map_batches(sample, count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.groupBy("word").pivot("lang", languages).agg(F.sum("n")).na.fill(0)
    words = stored(words.select("word", F.array(*[F.col(f"`{k}`").cast("double") for k in languages]).alias("counts")), "language-words")

    for _ in range(rounds):
        now = model

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            total = np.zeros_like(now.table)
            for batch in batches:
                own = batch.column("word").to_pylist()
                counts = np.array(batch.column("counts").to_pylist()).reshape(len(own), -1)
                for k in range(0, len(own), 2048):
                    total += now.expected(own[k:k + 2048], counts[k:k + 2048])
            used = np.nonzero(total.any(axis=1))[0]
            yield {"piece": used, "sums": total[used].tolist()}

        sums = map_batches(words.coalesce(24), expect, "piece int, sums array<double>").groupBy("piece").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(len(languages))])
        table = np.full_like(model.table, 0.05)
        for r in sums.collect():  # a row for each piece of the vocabulary at most
            table[r.piece] += [r[f"s{k}"] or 0.0 for k in range(len(languages))]
        model = Model(pieces, languages, table / table.sum(axis=0))
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: key, lang_pred, score (0 to 1), loglik (per letter), letters, and the columns named in ``keep``.

    Texts that are null or have no letter are ``und`` with score 0 and no loglik. Null keys and repeated rows pass through.
    """
    columns = [docs.schema[c] for c in (key, *keep)]
    schema = T.StructType([*columns, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("loglik", T.DoubleType()), T.StructField("letters", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = scorer.score(texts_of(batch, "_text"))
            yield {**{f.name: batch.column(f"_k{i}") for i, f in enumerate(columns)}, "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "loglik": [r[2] for r in rows], "letters": [r[3] for r in rows]}

    rows = docs.select(*[docs[f.name].alias(f"_k{i}") for i, f in enumerate(columns)], docs[text].alias("_text"))
    return map_batches(rows, kernel, schema)


def like_labelled(scored: DataFrame, label: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``scored`` (what ``identify`` returns, with a label and a text) whose loglik fits their predicted language.

    The distribution is that of all distinct texts whose label is the predicted language. Rows of a language without such
    texts, and those without a loglik, stay. Of ``scored`` two passes are made, so it should be a stored table.
    """
    own = scored.where((F.col(label) == F.col("lang_pred")) & F.col("loglik").isNotNull())
    own = own.groupBy("lang_pred", F.xxhash64(text).alias("copy")).agg(F.first("loglik").alias("loglik"), F.first("letters").alias("letters"))
    own = stored(own.drop("copy"), "language-logliks")
    middle = own.groupBy(F.col("lang_pred").alias("_lang")).agg(F.percentile_approx("loglik", [0.05, 0.5]).alias("_q"))  # a row for each language
    off = F.abs(F.col("loglik") - F.col("_q")[1]) * F.sqrt("letters")  # in standard deviations of one letter
    limits = own.join(F.broadcast(middle), F.col("lang_pred") == F.col("_lang")).groupBy("_lang", "_q").agg(F.greatest(F.lit(1.0), 1.4826 * F.percentile_approx(off, 0.5)).alias("_one"))
    drop = F.greatest(F.lit(LEAST_DROP), TAIL * (F.col("_q")[1] - F.col("_q")[0])) + SHORT * F.col("_one") / F.sqrt("letters")
    joined = scored.join(F.broadcast(limits), F.col("lang_pred") == F.col("_lang"), "left")
    return joined.where(F.col("_lang").isNull() | F.col("loglik").isNull() | (F.col("loglik") >= F.col("_q")[1] - drop)).drop("_lang", "_q", "_one")
