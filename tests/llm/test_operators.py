"""Every operator against a plain version, on a fixture with nulls, empties, ties, copies and clashing columns."""

import hashlib
import os
import random
import tracemalloc

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from laminaflow.llm import (blocks, compression_rules, jaccard_groups, language_id, pii_contexts, piece_spans, positional_index,
                            queries, style_tree, suffix_dedup, token_pack, warc_shards)
from laminaflow.llm.components import components
from laminaflow.session import shared_dir


# ---- features of blocks --------------------------------------------------------------------------------------------

def test_buckets_are_even_whatever_the_features():
    rng = np.random.default_rng(1)
    low = rng.integers(0, 1 << 40, 200_000, dtype=np.uint64)  # crowd at the low end, as minimisers do
    sizes = np.bincount((blocks.scattered(low) >> np.uint64(58)).astype(int), minlength=64)
    assert sizes.max() <= 1.3 * sizes.mean() and len(sizes) == 64 and len(np.unique(blocks.scattered(low))) == len(np.unique(low))


def test_parity_bitmaps_differ_no_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n, d in ((5, 3), (200, 40), (1000, 700)):
        both, left, right = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, d, d // 2))
        a, b = (jaccard_groups.parity_words(np.concatenate([both, x])) for x in (left, right))
        assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= d + d // 2


# ---- 1 suffix arrays -----------------------------------------------------------------------------------------------

def test_repeats(docs, texts, same):
    got = suffix_dedup.dedup_documents(docs).collect()
    same([r for r in got], brute.repeats(texts))


def test_repeats_of_hot_anchors(docs, texts, same, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_SEGMENTS", 3)
    same(suffix_dedup.dedup_documents(docs).collect(), brute.repeats(texts))


def _tables_left(spark, before):
    return sorted({name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before})


def test_repeats_leave_only_what_is_read_later(spark, docs):
    before = set(os.listdir(shared_dir(spark)))
    assert suffix_dedup.dedup_documents(docs).count() == docs.count()
    assert _tables_left(spark, before) == ["blocks", "late-windows"]


def test_smallest_documents_of_windows():
    rng = random.Random(3)
    contents = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 30))) for _ in range(50)]
    windows, docs = np.array([len(c) - 5 for c in contents]), np.array([rng.randint(0, 20) for _ in contents])
    every = [(c[k:k + 6], d) for c, d in zip(contents, docs) for k in range(len(c) - 5)]
    assert suffix_dedup.smallest_documents(contents, windows, docs, 6).tolist() == [min(d for w, d in every if w == own) for own, _ in every]


def test_kept_bytes_are_the_rest(docs):
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert len(r.kept) == r.n_bytes - sum(s.stop - s.start for s in r.spans)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order_and_prefixes(seed):
    rng = random.Random(seed)
    contents = [bytes(rng.choice(b"ab\xc3" if seed % 2 else b"abcdefgh") for _ in range(rng.randint(8, 60))) for _ in range(40)] + [b"a" * 30, b"a" * 30]
    windows = np.array([rng.randint(1, len(c) - 7) for c in contents])
    own = suffix_dedup.Suffixes(contents, windows, 8)
    got = [contents[o][k:] for o, k in zip(own.owner, own.offset)]
    assert sorted((int(o), int(k)) for o, k in zip(own.owner, own.offset)) == [(o, k) for o, n in enumerate(windows) for k in range(n)]
    assert [g[:8] for g in got] == sorted(g[:8] for g in got)
    wanted = [next((j for j in range(8) if a[j] != b[j]), 8) for a, b in zip(got, got[1:])]
    assert own.common_prefixes().tolist() == [0, *wanted]


# ---- 2 compression bands -------------------------------------------------------------------------------------------

def test_quality_base(docs, texts, same):
    got = compression_rules.compression_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(got.collect(), [(i, *brute.base_quality(t)) for i, t in texts])


def test_compression_bands():
    rules = compression_rules.Rules()
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinsrhld") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(2000))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2000)) for _ in range(9)) for _ in range(1500))
    assert rules.score(prose)["kept"]
    assert not rules.score("spam and eggs " * 900)["kept"]
    assert not rules.score(noise)["kept"]
    inside = rules.score(prose + " buy" * 3000)  # a repeated stretch inside good prose
    assert inside["n_bad_chunks"] > 0 and not inside["kept"]


def test_compression_stretches():
    rules = compression_rules.Rules()
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinsrhld") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n // 4))[:n]
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    assert all(rules.score(prose(n))["kept"] for n in (2047, 2048, 2049, 4000, 4096, 300_000))
    end = rules.score(prose(2048) + noise(1900))  # the second half is never a chunk of the grid
    assert end["n_chunks"] == 2 and end["n_bad_chunks"] == 1 and not end["kept"]
    long = rules.score(prose(200_000) + noise(12_000) + prose(200_000))
    assert 2 < long["n_bad_chunks"] < 0.25 * long["n_chunks"] and not long["kept"]
    assert rules.score(prose(100_000) + noise(3000) + prose(100_000))["kept"]


# ---- 3 n-gram Jaccard join -----------------------------------------------------------------------------------------

def test_near_duplicates(docs, texts, same):
    same(jaccard_groups.near_duplicates(docs).collect(), brute.near_duplicates(texts))


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_chains(spark, same, seed):
    """Sets around the threshold, in chains, with pairs that only the last step finds."""
    rng = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(60)]
    for c in range(6):
        own = [rng.choice(words) for _ in range(40)]
        for _ in range(15):
            own = list(own)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own[:rng.randint(30, 40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_groups.near_duplicates(df).collect(), brute.near_duplicates(rows))


def test_near_copies_cost_no_square_of_their_number(spark, same, monkeypatch):
    """Copies of one text of which about every other pair is linked, and all of them by chains."""
    rng, rows, words = random.Random(8), [], [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(250)]
    for i in range(160):
        own = list(base)
        for _ in range(rng.randint(2, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    asked, verify = [], jaccard_groups.verify
    monkeypatch.setattr(jaccard_groups, "verify", lambda pairs, *more: asked.append(pairs.count()) or verify(pairs, *more))
    before = set(os.listdir(shared_dir(spark)))
    same(jaccard_groups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute.near_duplicates(rows))
    assert max(asked) < 4 * len(rows), asked
    assert _tables_left(spark, before) == ["text-groups"]


def test_small_labels_meet_the_largest_by_its_central_set(spark):
    """Behind one shingle stand a label of 40 sets, of which only the one that shares most is near the others, and 20 of one set."""
    ids = [*range(40), *range(100, 120)]
    label = lambda i: 0 if i < 40 else i
    lists = spark.createDataFrame([(5, i, 100, 99 if i == 7 else 90) for i in ids], "token long, gid long, size long, rest long")
    members = spark.createDataFrame([(i, 100, i) for i in ids], "id long, n long, gid long")
    labels = spark.createDataFrame([(i, 100, label(i)) for i in ids], "id long, n long, label long")
    bits = [0 if i == 7 or i >= 100 else -1 for i in ids]
    sets = spark.createDataFrame([(i, 100, *[x] * jaccard_groups.PARITY) for i, x in zip(ids, bits)], "id long, n long, " + ", ".join(f"{b} long" for b in jaccard_groups.BITS))
    found = jaccard_groups._witnesses(lists, members, labels, sets, 0, 75).collect()
    assert {(r.label, r.a, r.b) for r in found if r.to == 0} == {(i, 7, i) for i in ids if i >= 100}
    assert len(found) < 2 * len(ids)


def test_one_of_each_group_stays(docs, texts):
    kept = jaccard_groups.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    wanted = {(i, t) for (i, t), (_, n, c) in zip(texts, brute.near_duplicates(texts)) if n and c == i and i is not None}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert {(i, t) for i, t in got if i is not None and brute.shingles(t)} == wanted
    assert len(got) == len(set(got)), "ties stay once"
    assert sum(not brute.shingles(t) for _, t in got) == sum(not brute.shingles(t) for _, t in texts)


def test_components(spark, same):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 70)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    same(components(spark.createDataFrame(edges, "a long, b long")).collect(), root.items())


# ---- 4 SentencePiece -----------------------------------------------------------------------------------------------

def test_sentencepiece(docs, texts, same):
    pieces = piece_spans.decode_pieces(piece_spans.encode_pieces(docs, queries.PIECE_MODEL), queries.PIECE_MODEL)
    got = [(r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in pieces.collect()]
    same(got, brute.sentencepiece_rows(texts))


def test_spans_cover_the_text(texts):
    encoder = piece_spans.SpanEncoder(queries.PIECE_MODEL)
    for _, t in texts:
        raw = (t or "").encode()
        ids, starts, ends = encoder.encode(t or "")
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
        for k, a, b in zip(ids, starts, ends):
            if not encoder.byte_pieces[k] and b > a:
                assert encoder.library.id_to_piece(int(k)).replace("▁", " ").strip() == raw[a:b].decode().replace("▁", " ").strip()


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_longest_prefix_normalisation(rule):
    """The compiled map of a public normaliser, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=True)
    encoder = piece_spans.SpanEncoder.__new__(piece_spans.SpanEncoder)
    encoder.spec = pb.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    encoder.map, encoder.suffix = piece_spans.CharacterMap(encoder.spec.precompiled_charsmap), False
    for t in ["ﬁne ＡＢＣ １２", "  a  b\t c ", "é é ㍿ ½", "x​­z", "", "   ", "Ｔｅｓｔ　ｓｐａｃｅ", "ガ ﾊﾟ"]:
        out, align = encoder.normalize(t)
        assert out.decode().replace("▁", " ") == library.normalize(t).replace("▁", " "), t
        assert len(align) == len(out) + 1 and (np.diff(align) >= 0).all()


# ---- 5 WARC --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def page_rows(texts):
    return [(i, f"http://h{(i or 0) % 3}.example/{i}", f"<p>{t}</p>" if t is not None and (i or 0) % 4 else t) for i, t in dict(texts).items()]


def test_warc_round_trip(spark, page_rows, same):
    pages = spark.createDataFrame([(*r, "x") for r in page_rows], "page_id long, url string, html string, payload string").repartition(4)
    base, manifest = warc_shards.write_warc(pages, file_bytes=4000)
    back = warc_shards.read_warc(spark, base)
    rows = back.collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], brute.warc_rows([(i, h) for i, _, h in page_rows]))
    assert all(r.digest_ok for r in rows) and manifest.count() > 3
    bodies = {i: h for i, _, h in page_rows}
    assert all(r.payload.decode() == (bodies[r.page_id] or "") for r in rows if r.record_type == "response")


def test_warc_is_deterministic(spark, page_rows):
    def digests(n):
        pages = spark.createDataFrame(page_rows, "page_id long, url string, html string").repartition(n).coalesce(1)
        base, manifest = warc_shards.write_warc(pages, file_bytes=3000)
        return [r.content for r in spark.read.format("binaryFile").load(base).orderBy("path").collect() if r.content], manifest.count()
    assert digests(3) == digests(7)


def test_warc_ties(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, None, "a"), (None, "u", "b"), (3, "u", "b")], "page_id long, url string, html string")
    base, _ = warc_shards.write_warc(pages)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc_shards.read_warc(spark, base).collect())
    assert got == [(0, "response", 0), (1, "response", 0), (1, "revisit", 1), (2, "revisit", 1), (3, "response", 0)]


# ---- 6 language ----------------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces.load(queries.PIECE_MODEL)
    rng = np.random.default_rng(0)
    table = rng.random((pieces.n + 1, 2))
    model = language_id.Model(pieces, ["a", "b"], table / table.sum(axis=0))

    def brute_sum(word, lang):
        full, memo = "▁" + word, {}
        def ways(at):
            if at == len(full):
                return 1.0
            if at not in memo:
                total = 0.0
                for size in range(1, len(full) - at + 1):
                    codes, _ = language_id.encode_words([full[at:at + size]])
                    k = pieces.find(list(language_id.span_hashes(codes, size))[size - 1])[0, 0]
                    if size == 1 or k < pieces.n:
                        total += model.table[k, lang] * ways(at + size)
                memo[at] = total
            return memo[at]
        return ways(0)

    words = ["the", "reading", "ñandú", "x", "straße"]
    got = model.forward(words)
    for k, w in enumerate(words):
        assert np.allclose(got[k], [np.log(brute_sum(w, 0)), np.log(brute_sum(w, 1))])


def test_language_edges(spark, docs, nothing):
    train = spark.createDataFrame([("the house of the people and the rest", "en"), ("das haus und die leute sind hier", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language_id.fit(train, queries.PIECE_MODEL)
    assert model.languages == ["de", "en"]
    got = language_id.identify(docs, model)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {"de", "en", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (400, 401, 402))
    assert language_id.identify(nothing, language_id.fit(nothing, queries.PIECE_MODEL)).count() == 0


def test_numbers_are_no_letters(spark):
    """Signs like ² and ½ are no letters, so a text of them has no language; clashing columns are not read."""
    model = language_id.fit(spark.createDataFrame([("the house of the people", "en"), ("das haus und die leute", "de")], "text string, lang string"), queries.PIECE_MODEL)
    docs = spark.createDataFrame([(1, "² ½ ³ 12 _", "x"), (2, "the house²", "x"), (3, "½" * 100_000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[1] == got[3] == ("und", 0) and got[2][0] == "en"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_fit_counts_copies_once(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["the", "house", "people", "water"]) for _ in range(8)) + f" {chr(97 + k % 26)}{chr(97 + k // 26)}", "en") for k in range(200)]
    copied = [(f"das haus und die leute {chr(97 + k)}", "de") for k in range(3)]
    fit = lambda rows: language_id.fit(spark.createDataFrame(rows, "text string, lang string"), queries.PIECE_MODEL, fit_rows=20, rounds=1)
    plain, heavy = fit(rows + copied), fit(rows + copied * 300 + rows[:1] * 3000)
    assert np.allclose(plain.table, heavy.table)
    assert plain.table[:, 0].max() > 2 * plain.table[:, 0].min()  # a language of few texts has them all


# ---- 7 token files -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_pack.pack(ids, bits)
    assert len(raw) == (1001 * bits + 7) // 8
    assert (token_pack.unpack(raw, 1001, bits) == ids).all()


def test_random_access():
    ids = np.arange(20_000, dtype=np.uint32) % 777
    file = token_pack.PackedFile(token_pack.file_bytes(ids, [3, None, 9], [5, 0, 19_995], 10))
    assert file.keys == [3, None, 9] and (file.document(2) == ids[5:]).all() and len(file.document(1)) == 0
    assert (file.ids(4090, 20) == ids[4090:4110]).all()


def test_token_files(spark, docs, texts, same):
    base, manifest = token_pack.write_token_files(docs, queries.BYTE_MODEL, queries.END_ID, file_ids=900)
    got = token_pack.read_token_files(spark, base, manifest)
    same(got.drop("ids").collect(), brute.token_rows(texts))
    assert manifest.count() > 5 and got.where(F.size("ids") != F.col("n_tokens")).isEmpty()


# ---- 8 personal data -----------------------------------------------------------------------------------------------

PRIVATE = [
    "mail a.b@c.de, x@y.z.w and @no or a@b", "ip 1.2.3.4.5.6.7.8 or 999.1.1.1 not 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111000000000000",
    "call +1 (017) 555-7713 or +49.30.1234567) now +1 2", "é😀 a@b.co 10.0.0.1", "a@b.c_x@d.e", "5555555555554444-5 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "a" * 5000 + "@" + "b." * 3000 + "com", "1 " * 4000, None, "",
]


def test_base_spans(spark, docs, texts, same):
    rows = [(1000 + k, t) for k, t in enumerate(PRIVATE)] + texts
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, base int, spans int, _key int")
    found = pii_contexts.with_spans(pii_contexts.hashed_rows(df, F.struct("*")), pii_contexts.personal_data(df)).select("_row.doc_id", "base")
    got = [(r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.base)) for r in found.collect()]
    same(got, [(i, ",".join(brute.personal_data(t))) for i, t in rows])


def test_contexts_find_unseen(spark):
    rows = [(k, f"some words please call me +1 555 010 {k:04d} thanks") for k in range(40)]
    rows += [(100 + k, f"lorem please call me (030) 555-{k:04d} ok") for k in range(2)] + [(200 + k, f"the order number 030 555-{k:04d} shipped") for k in range(30)]
    found = pii_contexts.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r._key: [s for s in r.spans if s not in r.base] for r in found}
    assert all(len(added[100 + k]) == 1 for k in range(2))
    text = rows[40][1]
    assert text[added[100][0].start:added[100][0].stop] == "(030) 555-0000"
    assert not any(k >= 200 for k in added)


def test_contexts_of_lists_and_first_words(spark):
    """A member of a list has the earlier member as context; a first word alone is a context; white space is one space."""
    rows = [(k, f"+1 555 010 {k:04d},\n+1 555 011 {k:04d}") for k in range(40)] + [(100, "+1 555 019 9999, (030) 555-0003"), (101, "see (030) 555-0002, (030) 555-0003")]
    rows += [(200 + k, f"Telefon: +1 555 012 {k:04d}") for k in range(40)] + [(300, "telefon:\t030 555-1234"), (301, "(030) 555-4444 tons")]
    found = pii_contexts.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    added = {r._key: [text[r._key][s.start:s.stop] for s in r.spans if s not in r.base] for r in found}
    assert added[300] == ["030 555-1234"] and "(030) 555-0003" in added[101] and not added.get(301)


def test_masking(spark, docs):
    df = spark.createDataFrame([(1, "é a@b.co and 10.0.0.1.", "keep"), (2, None, "x"), (3, "none", "y"), (4, "4111 1111 1111 1111", "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii_contexts.without_personal_data(df).collect()}
    assert got[1].text == "é <EMAIL> and <IP>." and got[2].text is None and got[3].text == "none" and got[4].text == "<CARD>" and got[1].spans == "keep"
    assert pii_contexts.without_personal_data(docs).columns == docs.columns


# ---- 9 style trees -------------------------------------------------------------------------------------------------

def test_main_text(spark):
    site = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/x>Home</a></nav><div class='x-menu'>menu</div>{}<footer>&copy; x</footer></body></html>"
    pages = [(1, "http://a.b/1", site.format("<article><h1>Head&amp;line</h1><p><b>One\n two<br>three<p>Second &eacute;</p><script>var a='</p>';</script><!-- no --><section class=comments><p>troll</p></section></article>")),
             (2, "http://a.b/2", site.format("<div class=story><p>Alone  here</p><ul><li>x<li>y</ul></div><form>f</form>")), (3, None, None), (4, "http://a.b/4", ""), (None, "u", "plain < text"), (5, "http://a.b/5", "<p>cut <b")]
    got = {r.page_id: r.text for r in style_tree.extract_text(spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")).collect()}
    assert got[1] == "Head&line\nOne two three\nSecond é" and got[2] == "Alone here\nx\ny" and got[3] == "" and got[4] == "" and got[None] == "plain < text"


def test_repeated_branches_go(spark):
    page = "<body><div id=top><b>Welcome to our site</b></div><div id=text><p>{}</p></div><div id=low>All rights kept</div></body>"
    rows = [(k, "https://Site.example:80/x", page.format(f"Story number {k} tells something {k * k}")) for k in range(30)]
    got = style_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Story number {k} tells something {k * k}" for k in range(30)}
    tree = {r.path: r.importance for r in style_tree.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert tree["#/body/div.text"] > 0.7 > 0.1 > tree["#/body/div.low"]


def test_repeated_branches_inside_articles_go(spark):
    page = "<body><article id=post-{0} class='entry item-{0}'><h1>Title {0}</h1><p>Story number {0} tells something {1}</p><div><p>Read more of our offers here</p></div></article></body>"
    copied = "<body><article><p>The same story</p><section><p>told again and again</p></section></article></body>"
    rows = [(k, "https://site.example/x", page.format(k, k * k)) for k in range(30)]
    rows += [(100 + k, "https://mirror.example/x", copied) for k in range(30)] + [(200 + k, "https://near.example/x", f"<!-- {k} -->{copied}") for k in range(30)]
    got = {r.page_id: r.text for r in style_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nStory number {k} tells something {k * k}" for k in range(30))
    assert all(text == "The same story\ntold again and again" for k, text in got.items() if k >= 100)


def test_names_are_evidence():
    text = lambda html: style_tree.main_text(html, set())
    for name in ("no-sidebar", "has-sidebar content", "comments-open", "post-12 category-social", "ad-free", "related-work", "widget", "menu"):
        assert text(f"<body><div class='{name}'><article><p>Story</p></article></div></body>") == "Story", name
    assert text("<article class='category-social tag-ads'><p>Story</p><section id=share-prices><p>Prices</p></section></article>") == "Story\nPrices"
    assert text("<main><h1>Head</h1><div class=widget><article>Story</article></div></main>") == "Head\nStory"
    for name in ("comments", "comment-list", "share-bar", "related-posts", "site-footer", "cookie_banner"):
        assert text(f"<article><p>Story</p><div class='{name}'><p>Other</p></div></article>") == "Story", name
    assert text("<article><p>Story</p><div class=related-reading><a href=x>One</a> <a href=y>two</a></div></article>") == "Story"
    assert text("<article>Story</article><section class=comments><article class=comment>Troll</article></section>") == "Story"


def test_deep_pages_take_little():
    deep = "<div class=box>" * 100_000 + "<p>Deep down" + "</div>" * 100_000 + "</b>" * 100_000
    tracemalloc.start()
    try:
        assert style_tree.main_text(deep, set()) == "Deep down"
        assert len(style_tree.node_features(deep, frozenset(["box"]))) == 100_002
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()


# ---- 10 positional index -------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def bench_items(texts):
    own = {i: t for i, t in texts if i is not None}
    return [(1, " ".join(own[300].split()[10:40])), (2, "One two, THREE"), (3, None), (4, "..."), (10, own[100][:200].upper()), (11, "x x x x x x x x x x x x"), (None, own[5]), (5, "never seen words of any kind at all in here really")]


def test_contamination(spark, docs, texts, bench_items, same):
    items = spark.createDataFrame(bench_items, "item_id long, text string")
    found = positional_index.contamination(docs, items)
    got = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    same(got, brute.contamination(texts, bench_items))
    assert positional_index.without_contaminated(docs, items).count() == sum(not r[5] for r in brute.contamination(texts, bench_items))


def test_proximity(spark):
    keyed = positional_index.document_key(spark.createDataFrame([(1, "zero alpha one beta two gamma"), (2, "alpha x x x x beta gamma"), (3, "gamma beta alpha")], "d long, t string"), "d", "t")
    windows, _ = positional_index.windows_of(spark.createDataFrame([(1, "alpha beta gamma")], "i long, t string"), "i", "t")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    anchors = positional_index.rarest_terms(windows, positional_index.term_counts(keyed, terms))
    near = positional_index.near_matches(positional_index.postings(keyed, terms), anchors, 2)
    assert [r._key for r in near.collect()] == [1]


def test_near_columns(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    inserted = " ".join(w + (" extra" if k % 8 == 4 else "") for k, w in enumerate(words))
    changed = " ".join("other" if k % 10 == 4 else w for k, w in enumerate(words))
    rows = [(1, inserted), (2, changed), (3, "before it " + " ".join(words)), (4, " ".join(reversed(words))), (5, " ".join(words[::2])), (6, None), (6, ""), (None, changed), (2, changed)]
    items = [(7, " ".join(words[:20])), (8, " ".join(words[20:29]) + " unheard"), (9, "wholly unseen words " * 4), (None, " ".join(words[30:]))]
    got = positional_index.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    told = sorted((r.doc_id or 0, r.contaminated, r.near, ",".join(r.near_items)) for r in got)
    assert told == [(0, False, True, "7"), (1, False, True, "7,8"), (2, False, True, "7"), (2, False, True, "7"), (3, True, True, "7,8"),
                    (4, False, False, ""), (5, False, False, ""), (6, False, False, ""), (6, False, False, "")]


def _is_near(words, item, slack=2):
    """Whether some start has all words of a window but one in ten within ``slack`` of their due places."""
    places = [[k for k, w in enumerate(words) if w == x] for x in item]
    for start in range(-len(item) - slack, len(words) + slack):
        if sum(not any(abs(p - start - i) <= slack for p in own) for i, own in enumerate(places)) <= len(item) // 10:
            return True
    return False


def test_proximity_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{chr(97 + k)}" for k in range(26)]
    item = "rareone ca cb cc cd ce cf cg ch raretwo".split()
    rows, items = [(0, "pad pad ca cb rareone cc cd ce cf raretwo cg ch end".split())], [(0, item)]
    items += [(k, [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 10, 12]))]) for k in range(1, 9)]
    for k in range(1, 120):
        own = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(own))
            if rng.random() < 0.5:
                own.insert(at, rng.choice(vocabulary))
            elif rng.random() < 0.5:
                own[at] = "other"
            else:
                own.append(own.pop(at)) if rng.random() < 0.3 else own.insert(max(0, at - 2), own.pop(at))
        rows.append((k, [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))] + own))
    found = positional_index.contamination(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string"),
                                           spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    got = {r.doc_id: r.near_items for r in found.collect()}
    windows = {str(k): [w[a:a + 10] for a in range(max(1, len(w) - 9))] for k, w in items}
    wanted = {k: sorted(i for i, own in windows.items() if any(_is_near(w, x) for x in own)) for k, w in rows}
    assert got == wanted and "0" in got[0] and any(not x for x in got.values())


# ---- all -----------------------------------------------------------------------------------------------------------

def test_empty_tables(spark, nothing):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.dedup_documents(nothing).count() == 0
    assert compression_rules.compression_quality(nothing).count() == 0
    assert jaccard_groups.near_duplicates(nothing).count() == 0
    assert jaccard_groups.without_near_duplicates(nothing).count() == 0
    assert piece_spans.encode_pieces(nothing, queries.PIECE_MODEL).count() == 0
    base, _ = warc_shards.write_warc(pages)
    assert warc_shards.read_warc(spark, base).count() == 0
    base, manifest = token_pack.write_token_files(nothing, queries.BYTE_MODEL, 2)
    assert token_pack.read_token_files(spark, base, manifest).count() == 0
    assert pii_contexts.with_spans(pii_contexts.hashed_rows(nothing, F.struct("*")), pii_contexts.personal_data(nothing)).count() == 0 and pii_contexts.without_personal_data(nothing).count() == 0
    assert style_tree.extract_text(pages).count() == 0
    assert positional_index.contamination(nothing, items).count() == 0
