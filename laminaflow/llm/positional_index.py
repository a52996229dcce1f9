"""Benchmark decontamination with a positional inverted index of the training text.

The index has a posting (term, document, position) for each training token that the test windows need. A window is
found by intersecting the posting lists of its rarest terms, each shifted back by the term's place in the window; what
survives is compared word by word. Proximity matches allow the shifted places to differ a little and one word in ten to
be another; they start from any of the two rarest terms, of which one must be there. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminaflow.llm.tables import ascii_lower, stored

#: What stands between words, after A-Z became a-z.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z became a-z; leaves as many words.
BETWEEN_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW_WORDS = 10
#: So many rarest terms of a window are intersected before words are compared.
RAREST = 3
#: In a proximity match each word stands at most SLACK words from its due place; one of every NEAR_WORDS words may be lacking.
SLACK, NEAR_WORDS = 2, 10


def words_of(text: Column) -> Column:
    """Words in order; null for a null text."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, BETWEEN_ANY_CASE), ""))).cast("long")


def windows_of(items: DataFrame, key: str, text: str, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words, n) and which item has which (item, window_id).

    An item of fewer words than ``size`` is one window; one without words, or null, has none.
    """
    words = items.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("words"))
    cut = stored(cut.select("item", F.sha2(F.array_join("words", " "), 256).alias("window_id"), "words").distinct(), "windows")
    windows = cut.select("window_id", "words").dropDuplicates(["window_id"]).withColumn("n", F.size("words"))
    return stored(windows, "distinct-windows"), cut.select("item", "window_id")


def document_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _hash, _text): rows with equal key and text are one document, equal keys with other texts are not."""
    return docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index over ``terms``: term, _key, _hash, position (from 0)."""
    places = docs.select("_key", "_hash", F.posexplode(words_of(F.col("_text"))).alias("position", "term"))
    return places.join(terms, "term")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    words = docs.select(F.explode(words_of(F.col("_text"))).alias("term"))
    return words.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(window_id, n, term, offset, rank, need): the rarest terms of each window that can occur at all."""
    places = windows.select("window_id", "n", F.posexplode("words").alias("offset", "term"))
    known = places.join(counts, "term")
    within = Window.partitionBy("window_id")  # at most a window's words
    ranked = known.withColumns({"found": F.count(F.lit(1)).over(within), "rank": F.row_number().over(within.orderBy("uses", "term", "offset")) - 1})
    return ranked.where((F.col("found") == F.col("n")) & (F.col("rank") < rarest)).select("window_id", "n", "term", "offset", "rank", F.least("n", F.lit(rarest)).alias("need"))


def near_anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window_id, n, term, offset): of each window, one known term more than those that may still be lacking.

    At least one of them stands in each proximity match; a window with more unknown terms than may lack has none.
    """
    places = windows.select("window_id", "n", F.floor(F.col("n") / NEAR_WORDS).alias("miss"), F.posexplode("words").alias("offset", "term"))
    within = Window.partitionBy("window_id")  # at most a window's words
    ranked = places.join(counts, "term").withColumns({"found": F.count(F.lit(1)).over(within), "rank": F.row_number().over(within.orderBy("uses", "term", "offset")) - 1})
    return ranked.where(F.col("rank") <= F.col("miss") - (F.col("n") - F.col("found"))).select("window_id", "n", "term", "offset")


def near_hits(index: DataFrame, anchors: DataFrame, keyed: DataFrame, windows: DataFrame, slack: int = SLACK) -> DataFrame:
    """(_key, _hash, window_id): documents and windows with a place where all words but n / NEAR_WORDS stand within ``slack`` of their due places.

    The anchor itself may be ``slack`` off its place, so every start that near to the one it tells is tried.
    """
    seeds = index.join(anchors, "term").select("_key", "_hash", "window_id", "n", (F.col("position") - F.col("offset")).alias("start")).distinct()
    seeds = stored(seeds, "near-candidates")
    texts = candidate_texts(seeds, keyed)
    asked = seeds.join(windows.select("window_id", "words"), "window_id")
    joined = asked.join(texts, asked["_key"].eqNullSafe(texts["_k"]) & (asked["_hash"] == texts["_h"]))
    around = lambda first, last: f"slice(_words, greatest({first}, 0) + 1, greatest({last} - greatest({first}, 0) + 1, 0))"
    some = F.expr(f"size(array_except(words, {around(f'start - {2 * slack}', f'start + n - 1 + {2 * slack}')})) <= n div {NEAR_WORDS}")
    lacking = f"size(filter(sequence(0, n - 1), i -> not array_contains({around(f's + i - {slack}', f's + i + {slack}')}, words[i])))"
    lacking = F.expr(f"exists(sequence(start - {slack}, start + {slack}), s -> {lacking} <= n div {NEAR_WORDS})")
    return joined.where(some).where(lacking).select("_key", "_hash", "window_id").distinct()


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(_key, _hash, window_id, n, start): places where all rarest terms stand as they do in the window.

    The list of the rarest term, shifted, is looked up in the lists of the others; only its places travel.
    """
    first, others = anchors.where("rank = 0"), anchors.where("rank > 0").select("window_id", "rank", "term", "offset")
    seeds = index.join(first, "term").select("_key", "_hash", "window_id", "n", "need", (F.col("position") - F.col("offset")).alias("start")).where("start >= 0")
    asked = seeds.join(others, "window_id").withColumn("position", F.col("start") + F.col("offset"))
    same = asked["_key"].eqNullSafe(index["_key"]) & (asked["_hash"] == index["_hash"]) & (asked["term"] == index["term"]) & (asked["position"] == index["position"])
    seen = asked.join(index, same, "left_semi").groupBy("_key", "_hash", "window_id", "n", "need", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("seen"))
    place = ["_key", "_hash", "window_id", "n", "start"]
    return seen.where(F.col("seen") + 1 == F.expr("shiftleft(1, need) - 1")).select(*place).unionByName(seeds.where("need = 1").select(*place).distinct())


def candidate_texts(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """(_k, _h, _words) of the documents with a candidate; only these are cut into words again.

    (A nullable list of words would be computed for all texts, to filter out nulls before the join.)
    """
    needed = candidates.select("_key", "_hash").distinct()
    wanted = docs["_key"].eqNullSafe(needed["_key"]) & docs["_hash"].eqNullSafe(needed["_hash"])
    rows = docs.join(needed, wanted, "left_semi").dropDuplicates(["_key", "_hash"])
    return rows.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.coalesce(words_of(F.col("_text")), F.array().cast("array<string>")).alias("_words"))


def verified(candidates: DataFrame, docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates whose words all equal the window's; only texts with a candidate are cut into words again.

    (A nullable list of words would be computed for all texts, to filter out nulls before the join.)
    """
    needed = candidates.select("_key", "_hash").distinct()
    same = lambda a, b: a["_key"].eqNullSafe(b["_key"]) & a["_hash"].eqNullSafe(b["_hash"])
    texts = docs.join(needed, same(docs, needed), "left_semi").select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.coalesce(words_of(F.col("_text")), F.array().cast("array<string>")).alias("_words"))
    asked = candidates.join(windows.select("window_id", "words"), "window_id")
    joined = asked.join(texts, asked["_key"].eqNullSafe(texts["_k"]) & (asked["_hash"] == texts["_h"]))
    return joined.where(F.slice("_words", F.col("start") + 1, F.col("n")) == F.col("words")).select("_key", "_hash", "window_id", "n", "start")


def near_matches(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """(_key, _hash, window_id, start): the rarest term's place, where every other rarest term stands within ``slack`` words of its due place."""
    cell = slack + 1
    shifted = index.join(anchors, "term").withColumn("start", F.col("position") - F.col("offset"))
    seed = shifted.where("rank = 0").select("_key", "_hash", "window_id", "need", F.col("start").alias("seed"), F.explode(F.array(*[F.floor(F.col("start") / cell) + k for k in (-1, 0, 1)])).alias("cell"))
    others = shifted.where("rank > 0").select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.col("window_id").alias("_w"), "rank", "start", F.floor(F.col("start") / cell).alias("_c"))
    close = seed.join(others, seed["_key"].eqNullSafe(others["_k"]) & (seed["_hash"] == others["_h"]) & (seed["window_id"] == others["_w"]) & (seed["cell"] == others["_c"]), "left")
    near = F.abs(F.col("start") - F.col("seed")) <= slack
    seen = close.groupBy("_key", "_hash", "window_id", F.col("seed").alias("start")).agg(F.coalesce(F.bit_or(F.when(near, F.expr("shiftleft(1, rank)"))), F.lit(0)).alias("seen"), F.max("need").alias("need"))
    return seen.where(F.col("seen") + 1 == F.expr("shiftleft(1, need) - 1")).drop("seen", "need")


def window_hits(keyed: DataFrame, items: DataFrame, item_key: str, item_text: str, size: int = WINDOW_WORDS, rarest: int = RAREST,
                near: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(_key, _hash, window_id, n, start) of all occurrences of windows in the documents, the windows of each item, and the proximity matches if ``near``."""
    windows, owners = windows_of(items, item_key, item_text, size)
    terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = stored(term_counts(keyed, terms), "term-counts")
    anchors = stored(rarest_terms(windows, counts, rarest), "anchors")
    close = stored(near_anchors(windows, counts), "near-anchors") if near else anchors
    index = stored(postings(keyed, stored(anchors.select("term").union(close.select("term")).distinct(), "anchor-terms")), "postings")
    candidates = stored(phrase_candidates(index, anchors), "candidates")
    hits = stored(verified(candidates, keyed, windows), "hits")
    return hits, owners, stored(near_hits(index, close, keyed, windows), "near-hits") if near else None


def without_contaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all columns, whatever their names; null texts stay."""
    hits, _, _ = window_hits(document_key(docs, doc_key, doc_text), items, item_key, item_text)
    hit = hits.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), docs[doc_key].alias("_key"), F.xxhash64(docs[doc_text]).alias("_hash"))
    return rows.join(hit, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_anti").select("_row.*")


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", size: int = WINDOW_WORDS, rarest: int = RAREST, near: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items (ids as sorted strings), contaminated, and for ``near`` more.

    Those are n_near (distinct windows with a proximity match, exact ones among them), near_items and near.

    Null and empty texts have no words and no hits. Rows that repeat a key and text get the same result; rows that share
    a key but not the text are judged apart; a null key is a key. Items without an id can hit, but are neither listed
    nor counted. Other columns are not read. A document's list of items is bounded by the benchmark.
    """
    keyed = document_key(docs, doc_key, doc_text)
    hits, owners, close = window_hits(keyed, items, item_key, item_text, size, rarest, near)

    in_order = Window.partitionBy("_key", "_hash").orderBy("start", "stop")
    spans = hits.select("_key", "_hash", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    spans = spans.withColumn("upto", F.coalesce(F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    covered = spans.groupBy("_key", "_hash").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "upto"), F.lit(0))).alias("n_hit"))
    named = hits.select("_key", "_hash", "window_id").distinct().join(owners, "window_id").where(F.col("item").isNotNull())
    named = named.groupBy("_key", "_hash").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = covered.join(named.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "items"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left").select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "n_hit", "items")
    base = keyed.select("_key", "_hash", word_count(F.col("_text")).alias("n_words"))
    out = base.join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    exact = [F.col("_key").alias(doc_key), "n_words", hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (hit > 0).alias("contaminated")]
    if close is None:
        return out.select(*exact)
    ids = F.array_sort(F.collect_set(F.col("item").cast("string")))
    near_found = close.join(owners, "window_id").groupBy(F.col("_key").alias("_nk"), F.col("_hash").alias("_nh")).agg(F.count_distinct("window_id").alias("n_near"), ids.alias("near_items"))
    out = out.join(near_found, F.col("_key").eqNullSafe(F.col("_nk")) & (F.col("_hash") == F.col("_nh")), "left")
    return out.select(*exact, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"), F.col("n_near").isNotNull().alias("near"))
