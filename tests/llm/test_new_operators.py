"""Line bitmaps, conversation repair and token links against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laminaflow.llm import line_bitmaps, queries, token_links, turn_repair


# ---- 11 line bitmaps -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lined():
    """(doc_id, text) with shared lines, a line in most documents, ties, nulls, odd white space and long texts."""
    rng = random.Random(9)
    lines = [" ".join(rng.choice("lorem ipsum dolor sit amet éüß consectetur".split()) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    hot = "this very common line is nearly everywhere"
    rows = []
    for i in range(150):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 8))] + [f"only document {i} holds this line"] * rng.randint(0, 3)
        own += [rng.choice([hot, hot.upper(), f"\t {hot} \x0b"])] if rng.random() < 0.8 else []
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(None, hot + "\n" + lines[0]), (None, hot), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, "é" * 19), (204, "é" * 20), (205, "é" * 20 + " "), (206, " " + "É" * 20),
             (207, "é" * 20), (5, rows[5][1]), (5, rows[5][1]), (6, hot), (-7, hot), (208, "\n".join(lines * 400)), (209, "x" * 2_000_000 + "\n" + hot), (210, hot + "\n" + hot)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def lined_docs(spark, lined):
    return spark.createDataFrame([(i, t, 1, b"x", "t") for i, t in lined], "doc_id long, text string, n_lines int, keep binary, tag string").repartition(6)


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_kept_lines(spark, lined_docs, lined, same, partitions):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many borders
        found = line_bitmaps.kept_lines(lined_docs)
        same(found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect(), brute.line_rows(lined))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bitmaps_say_what_is_kept(lined_docs, lined):
    wanted = {}
    for i, n, dropped, _ in brute.line_rows(lined):
        wanted.setdefault(i, []).append((n, dropped))
    got = {}
    for r in line_bitmaps.keep_bitmaps(lined_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped))
        assert (r.keep is None) == (r.n_dropped == 0)
        if r.keep is not None:
            assert int((~line_bitmaps.unpack_bits(r.keep, r.n_lines)).sum()) == r.n_dropped
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


@pytest.mark.parametrize("seed", range(8))
def test_stream_of_runs(seed, monkeypatch):
    """Whatever the batches and borders, dropped and settled open records are those of the plain rule."""
    monkeypatch.setattr(line_bitmaps, "HELD_ROWS", 4)
    rng = random.Random(seed)
    rows = sorted({(rng.randint(0, 5), 0, -rng.randint(0, 9), rng.randint(0, 2)) for _ in range(80)})
    rows = [(a, b, -d, t) for a, b, d, t in rows]
    parts, at = [], 0
    while at < len(rows):
        size = rng.randint(1, 30)
        parts.append(rows[at:at + size])
        at += size
    dropped, waiting, seen = set(), [], {}
    for part in parts:
        batches, at = [], 0
        while at < len(part):
            size = rng.randint(1, 9)
            cut = part[at:at + size]
            batches.append(pa.record_batch({"h1": [r[0] for r in cut], "h2": [r[1] for r in cut], "doc": [r[2] for r in cut], "tag": [r[3] for r in cut],
                                            "n_lines": pa.array([9] * len(cut), pa.int32()), "places": pa.array([[1]] * len(cut), pa.list_(pa.int32()))}))
            at += size
        for out in line_bitmaps.first_documents(iter(batches), 3):
            for h, d, t, state in zip(*(np.array(out[c]).tolist() for c in ("h1", "doc", "tag", "state"))):
                if state == line_bitmaps.DROPPED:
                    dropped.add((h, d, t))
                elif state == line_bitmaps.OPEN:
                    waiting.append((h, d, t))
                else:
                    seen.setdefault(h, set()).add(d)
    dropped |= {(h, d, t) for h, d, t in waiting if len(seen[h]) >= 3 and d != max(seen[h])}
    holders = {}
    for h, _, d, _ in rows:
        holders.setdefault(h, set()).add(d)
    assert dropped == {(h, d, t) for h, _, d, t in rows if len(holders[h]) >= 3 and d != max(holders[h])}


def test_lines_of_nothing(nothing):
    assert line_bitmaps.kept_lines(nothing).collect() == [] and line_bitmaps.keep_bitmaps(nothing).collect() == []


# ---- 12 conversation repair ----------------------------------------------------------------------------------------

def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None], [6, 6, 2, 1, 0.3, 0.3])[0]
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", None, f"{turn} is fine.", f"{turn} ends  \t", "É."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed,segment", [(1, 1 << 20), (2, 2), (3, 1)])
def test_repair(spark, same, monkeypatch, seed, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT_ROWS", segment)  # seen by the driver's closures
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, k string").repartition(3)
    got = turn_repair.repair_digests(turn_repair.damaged(df), df)
    same(got.collect(), brute.repair_rows(brute.damage(rows), {r[0] for r in rows}))


def test_repair_of_one_long_conversation(spark, same):
    """All rows but a few in one conversation, over many partitions: solved by the product of its segments."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]) if t % 5 else "user", rng.choice(["Fine.", f"{t}.", f"{t} and"])) for t in range(3000)] + [(k, 0, "user", "Hello.") for k in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    plan = turn_repair.repair_plan(turn_repair.damaged(df))
    whole = turn_repair.repair_digests(turn_repair.damaged(df), df).collect()
    left = brute.damage(rows)
    same(whole, brute.repair_rows(left, {r[0] for r in rows}))
    assert plan.where("k = 7").agg(F.sum("cost")).first()[0] == next(r.cost for r in whole if r.conv_id == 7)
    turns = turn_repair.repaired_turns(turn_repair.damaged(df), plan).where("conv_id = 7").orderBy("place").collect()
    assert "".join(r.edit for r in turns) == next(r.audit for r in whole if r.conv_id == 7)
    roles = "".join(r.role[0] for r in turns if r.edit != "D")
    assert roles == "ua" * (len(roles) // 2)


@pytest.mark.parametrize("seed", range(5))
def test_powers_of_runs(seed):
    """Advancing a run by binary powers equals one row after another, and the matrix of a stretch equals its parts'."""
    rng = random.Random(seed)
    symbols = np.array([s for _ in range(12) for s in [rng.randrange(12)] * rng.choice([1, 2, 7, 100])], np.uint8)
    slow = turn_repair.FINISH
    for s in reversed(symbols.tolist()):
        slow = turn_repair._apply(turn_repair.row_matrix(s), slow)
    fast = turn_repair.FINISH
    for s, n in reversed(turn_repair.runs_of(symbols)):
        fast = turn_repair.before_run(s, n, fast)
    assert slow == fast == turn_repair._apply(turn_repair.segment_matrix(symbols), turn_repair.FINISH)
    cost, audit = turn_repair.solve(symbols)
    assert cost == slow[turn_repair.START] and len(audit.replace("I", "")) == len(symbols)
    k = len(symbols) // 3
    after = turn_repair._apply(turn_repair.segment_matrix(symbols[k:]), turn_repair.FINISH)
    head, state = turn_repair.unroll(symbols[:k], after, turn_repair.START)
    tail, end = turn_repair.unroll(symbols[k:], turn_repair.FINISH, state)
    assert head + tail + turn_repair.last_letters(end) == audit


def test_long_run_is_quick():
    cost, audit = turn_repair.solve(np.full(400_000, 3, np.uint8))  # as many user turns: every second one answers
    assert cost == 400_000 and audit == "KR" * 200_000


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair_digests(turn_repair.damaged(df), df).collect() == [] and turn_repair.repaired_turns(df).collect() == []


def test_repair_of_a_megabyte(spark, same):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(turn_repair.repair_digests(turn_repair.damaged(df), df).collect(), brute.repair_rows(brute.damage(rows), {1}))


# ---- 13 token links ------------------------------------------------------------------------------------------------

ODD = [" leading", "trailing ", "a  b", "a   b\n c", "▁mark", "tab\tand nul \x00 end", "<|endoftext|> and <s> </s> <0x41>", "don't we'll 1234567 12,345.67", "日本語 テキスト", "🙂🙃 é \u0085  x ​",
       "x" * 700, "\n", " ", "  ", "\x1c y \x1d", "end.\r\nnew ،؟", "ﬁ ½ Ⅷ", "word,word.word; (x) [y] --- ...", "﻿bom", "a \x01,b \x01. c"]


def test_links(spark, docs, texts, same, monkeypatch):
    monkeypatch.setattr(token_links, "BLOCK_BYTES", 5000)
    rows = texts + [(500 + k, t) for k, t in enumerate(ODD)]
    more = docs.unionByName(spark.createDataFrame([(500 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    same(token_links.link_counts(more, queries.BYTE_MODEL, queries.PIECE_MODEL).collect(), brute.link_rows(rows))


def test_remembered_stretches_equal_whole_texts():
    units = token_links.Units(queries.BYTE_MODEL, queries.PIECE_MODEL)
    assert units.splits
    rng = random.Random(3)
    many = ODD + [" ".join(rng.choice(ODD + ["plain", "words", "here."]) for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["", "é" * 300_000]
    for t, (n_a, n_b, written, pairs) in zip(many, units.align(many)):
        whole = token_links.Labelled(units.aligner, [t])
        assert (n_a, n_b, written) == (len(whole.a), len(whole.b), ";".join(token_links.written_groups(whole))), t[:60]
        assert np.frombuffer(pairs, "<i8").tolist() == whole.pairs().tolist()


@pytest.mark.parametrize("seed", range(6))
def test_pointer_doubling(seed):
    rng = random.Random(seed)
    total = 400
    a, b = (np.array(sorted(rng.sample(range(1, total), rng.choice([1, 20, 150]))) + [total]) for _ in range(2))
    cuts = sorted(set(a.tolist()) & set(b.tolist()))
    left, right = token_links.groups_of(a, b)
    assert left.tolist() == [next(k for k, c in enumerate(cuts) if c >= e) for e in a.tolist()]
    assert right.tolist() == [next(k for k, c in enumerate(cuts) if c >= e) for e in b.tolist()]


def test_aligned_tokens(spark, docs, nothing):
    for r in token_links.align_tokens(docs, queries.BYTE_MODEL, queries.PIECE_MODEL).collect():
        assert len(r.a_ids) == len(r.a_ends) == len(r.a_groups) and len(r.b_ids) == len(r.b_ends) == len(r.b_groups)
        if r.a_ids:
            ends = sorted(set(r.a_ends) & set(r.b_ends))
            assert r.a_groups == [next(k for k, c in enumerate(ends) if c >= e) for e in r.a_ends] if len(ends) < 400 else r.a_groups[-1] == len(ends) - 1
            assert r.a_ends[-1] == r.b_ends[-1]
    assert token_links.align_tokens(nothing, queries.BYTE_MODEL, queries.PIECE_MODEL).collect() == []
    assert token_links.link_counts(nothing, queries.BYTE_MODEL, queries.PIECE_MODEL).collect() == []


def test_words_are_cut_between_separators(spark):
    import re

    from laminaflow.llm.positional_index import word_count, words_of

    texts = [None, "", " ", "--a", "a--", "Ab-cD 9é\u00a0x\U0001f600y", "\x00\x7f", "@A[Z`a{z/0:9", "ß\nÀ\tİ", "word " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", words_of(F.col("t")).alias("w"), word_count(F.col("t")).alias("n")).collect()
    for r in rows:
        t = texts[r.i]
        want = None if t is None else re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        assert r.w == want and r.n == len(want or [])


def test_words_are_cut_without_a_match_object_each(spark):
    from laminaflow.llm.positional_index import words_of

    plan = spark.createDataFrame([("a b",)], "t string").repartition(2).select(words_of(F.col("t")).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "regexp_extract_all" not in plan
