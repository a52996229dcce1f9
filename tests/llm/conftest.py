import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "", str(x)) for x in r))


@pytest.fixture(scope="session")
def same():
    def compare(got, wanted):
        got, wanted = order(got), order(wanted)
        wrong = [(g, w) for g, w in zip(got, wanted) if g != w]
        assert len(got) == len(wanted) and not wrong, wrong[:3]
    return compare


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty and odd texts, ties."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinsrhldéü") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(30)
    rows = [(i, prose(rng.randint(3, 150)) + "\n" + prose(20)) for i in range(1, 60)]
    rows += [(100 + i, base) for i in range(6)]
    words = base.split()
    for i in range(30):  # near copies
        own = list(words)
        own[rng.randrange(len(own))] = prose(1)
        rows.append((200 + i, " ".join(own)))
    rows += [(300 + i, prose(15) + " " + passage + ", " + prose(15)) for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "a" * 3000), (404, "ab" * 900), (405, "a" * 200), (406, "one two three"), (407, "One TWO three"),
             (408, "日本語 テキスト " * 40), (409, "\x00 nul <|endoftext|> mid space  two   three \n\n x"), (410, "▁ ▁▁ marks"), (411, "Short."), (412, prose(4000)),
             (None, "no key " + prose(30)), (None, base), (None, None), (413, passage), (413, passage), (414, "twice one"), (414, "twice two " + prose(30)), (415, "x " * 400),
             (416, "same line here now\n" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With more columns whose names clash with those of the results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, ids string, spans int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "x", 2) for i, t in texts], schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
