"""Units of texts and what a worker remembers of them, against the libraries; rounds of verification."""

import random

import numpy as np
import pytest

from laminaflow.llm import piece_spans, queries, token_pack, units


def odd_texts(n):
    rng = random.Random(3)
    letters = ["a", "b", "word", " ", " ", "  ", ",", ".", "'s", "!", "\n", "\t", " ", " ", "　", "\x85", "\x1c", "é", "日本", "▁", "<|endoftext|>", "\x01", "\x00", "7", "«", "​", "😀"]
    return ["", " ", ".", ", a", "a . b", "a.b,c ,d", *["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(n)]]


@pytest.mark.parametrize("most", [10, 600_000])
def test_pieces_of_many_texts(most):
    encoder = piece_spans.SpanEncoder(queries.PIECE_MODEL)
    encoder.known.most = most
    texts = odd_texts(3000)
    for some in (texts, texts[:50], [""], [], ["plain text only", "and more  of it"]):
        n, *found = encoder.encode_many(some)
        cut = np.append(0, np.cumsum(n))
        for k, t in enumerate(some):
            ids, starts, ends = (x[cut[k]:cut[k + 1]] for x in found)
            assert ids.tolist() == encoder.library.encode(t)
            for x, y in zip((ids, starts, ends), encoder.encode(t)):
                assert x.tolist() == y.tolist(), t


@pytest.mark.parametrize("most", [10, 600_000])
def test_tokens_of_many_texts(most):
    encoder = token_pack.Encoder(queries.BYTE_MODEL)
    encoder.known.most = most
    texts = odd_texts(3000)
    for some in (texts, texts[:50], [""], []):
        assert [x.tolist() for x in encoder.encode_many(some)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_frequent_units_stay_when_rare_ones_are_forgotten():
    asked = []

    def encode(new):
        asked.extend(new)
        return [np.array([len(u)], "<i4").tobytes() for u in new]

    known = units.Remembered(encode, 100)
    for k in range(500):
        assert known.ids([b"often", b"rare %d" % k]) == [np.array([5], "<i4").tobytes(), np.array([len(b"rare %d" % k)], "<i4").tobytes()]
    assert asked.count(b"often") == 1 and len(known.fresh) + len(known.stale) <= 110


def test_rounds_end_when_nothing_is_asked(spark, monkeypatch):
    """Two near copies are united in the first round, so that no later one has anything to verify."""
    from laminaflow.llm import jaccard_groups
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "another text of some words here")], "doc_id long, text string")
    calls, verify = [], jaccard_groups.verify
    monkeypatch.setattr(jaccard_groups, "verify", lambda *args: calls.append(1) or verify(*args))
    assert sorted((r.doc_id, r.component_id) for r in jaccard_groups.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert len(calls) <= 5
