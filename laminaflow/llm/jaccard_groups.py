"""Exact n-gram Jaccard join by grouped prefixes.

A text's set holds its distinct word shingles. Shingles are ordered by how many texts have them, the rarest first; two
sets that reach the threshold share a shingle in their prefixes, and shingles of one text only can be left out, which
leaves most texts without any candidate. Texts with equal prefixes and set sizes form one group. Groups that share a
prefix shingle and fit in size are candidates; groups are then expanded and members verified on their whole sets.

The wanted result is what is linked, not the pairs: so a group's members and the groups behind a shingle are first
verified against one of them, and what is linked is united; then labels are verified against the largest that they meet
behind a shingle, and against another one, by their closest witnesses. Only pairs across what is still apart are verified
after that, all whose parity bitmaps don't rule it out. No link between different texts is lost, and a group of n copies
costs n verifications.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.llm.blocks import NO_KEY, Block, Polynomial, distinct_texts, feature_totals, mix, pack_blocks, totals_of, with_answers
from laminaflow.llm.components import components
from laminaflow.llm.tables import stored, stored_alone

SHINGLE_WORDS = 5
PERCENT = 75
WORDS_HASH = Polynomial(20240501)
#: Words of 64 bits of a set's parity bitmap: bit h is whether an odd number of its shingles hash to h. Two bitmaps differ in
#: no more bits than the sets differ in shingles, so a pair whose bitmaps differ in too many can't reach the threshold.
PARITY = 16
BITS = [f"bits{i}" for i in range(PARITY)]
#: Rounds of verifying against one partner each go on while they unite at least one in UNITED of those asked, MOST_ROUNDS
#: at most; WITNESS_ROUNDS at most follow, until one finds nothing. Whatever they leave apart is verified pair by pair, so
#: these only set the cost.
UNITED, MOST_ROUNDS, WITNESS_ROUNDS = 3, 8, 4


def shingle_hashes(block: Block, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For every text of the block its sorted distinct shingles as 64-bit hashes; A-Z count as a-z.

    A text of fewer words than ``size`` has its whole sequence as one shingle; one without words has none.
    """
    data = block.data + np.where((block.data >= 65) & (block.data <= 90), np.uint8(32), np.uint8(0))
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    WORDS_HASH.prepare(data)
    words = WORDS_HASH.stretch(starts, stops)
    WORDS_HASH.forget()
    first = np.searchsorted(starts, block.cut)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    long = len(words) - size + 1
    rolled = np.zeros(max(long, 0), np.uint64)
    for k in range(size if long > 0 else 0):
        rolled += words[k:k + long] * weights[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * weights[:b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _features(size: int):
    def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(block, size)]), return_counts=True)
    return features


def parity_words(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix(own) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def candidate_sets(blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, doc, digest, n, alone, prefix_key, prefix, tokens): set sizes of all texts, and the rest for those with a candidate.

    ``id`` is the text's own number, ``doc`` its smallest key.
    ``tokens`` are the shingles that another text has too, the rarest first; ``prefix`` those of them in the prefix;
    ``alone`` counts the shingles of this text only, which stand before them.
    """
    totals = feature_totals(blocks, _features(size), 1 / 6)

    def kernel(block: Block, answers: pa.Table) -> dict:
        sets = shingle_hashes(block, size)
        known, _ = _features(size)(block)
        count = totals_of(answers, known)
        prefixes, tokens, keys, single = [], [], [], []
        for own in sets:
            uses = count[np.searchsorted(known, own)]
            order = np.lexsort((own, uses))
            shared = order[uses[order] > 1]
            alone, n = len(own) - len(shared), len(own)
            single.append(alone)
            length = n - -(-percent * n // 100) + 1 - alone
            if n == 0 or length < 1:
                prefixes.append(None), tokens.append(None), keys.append(None)
                continue
            ranked = own[shared].view(np.int64)
            prefixes.append(ranked[:length]), tokens.append(ranked), keys.append(hashlib.md5(ranked[:length].tobytes()).hexdigest())
        bits = np.array([parity_words(own) for own in sets]).reshape(-1, PARITY)
        return {**{name: bits[:, i] for i, name in enumerate(BITS)}, "id": block.texts, "doc": block.ids, "digest": block.digests, "n": [len(s) for s in sets], "alone": single, "prefix_key": keys, "prefix": prefixes, "tokens": tokens}

    return with_answers(blocks, totals, kernel, "id long, doc long, digest string, n long, alone long, prefix_key string, prefix array<long>, tokens array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _reaches(a: Column, size_a: Column, b: Column, size_b: Column, percent: int) -> Column:
    """Whether sets can reach the threshold whose first common shingle has ``a`` and ``b`` shingles from it on."""
    most = F.least(a, b)
    return 100 * most >= percent * (size_a + size_b - most)


def _known_bits() -> list[Column]:
    """Of several sets: the bits that all have set, and those that none has."""
    return [f(c).alias(f"{p}{b}") for b in BITS for p, f, c in (("one_", F.bit_and, F.col(b)), ("no_", F.bit_and, F.bitwise_not(b)))]


def _same_bits(of: Callable[[str], Column]) -> list[Column]:
    return [F.bit_and(of(f"{p}{b}")).alias(f"{p}{b}") for b in BITS for p in ("one_", "no_")]


def _alike(left: str, right: str, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether any two sets of these sizes at most and with these known bits can reach the threshold: a necessary condition."""
    apart = [F.bit_count(F.col(f"{left}.one_{b}").bitwiseAND(F.col(f"{right}.no_{b}")).bitwiseOR(F.col(f"{left}.no_{b}").bitwiseAND(F.col(f"{right}.one_{b}")))) for b in BITS]
    return reduce(lambda x, y: x + y, apart) * (100 + percent) <= (size_a + size_b) * (100 - percent)


def _bits_struct(name: str) -> Column:
    return F.struct(*[f"{p}{b}" for b in BITS for p in ("one_", "no_")]).alias(name)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and what else comes with them) whose whole sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select(pairs.columns)


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels (id, n, label) with those in ``merged`` (label, to) replaced."""
    return stored(labels.join(merged, "label", "left").select("id", "n", F.coalesce("to", "label").alias("label")), "labels")


def _united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, n, label) after the links (a, b) between ids."""
    of = labels.select("id", "label")
    edges = links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b")
    return _relabelled(labels, components(edges).select(F.col("node").alias("label"), F.col("component").alias("to")))


def _by_turn(name: str, turn: int) -> Column:
    return F.xxhash64(name, F.lit(str(turn)))  # a string is no part of the generated code, so that all turns share it


def _witnesses(lists: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame, turn: int, percent: int) -> DataFrame:
    """(label, to, weight, a, b): for two labels of which one is a pivot behind some shingle of the other, the two sets whose
    bitmaps differ least, of one set each behind every shingle: in even turns the set that shares most, which more sets are
    near to than to others, in odd turns any. ``to`` is the label of more sets.

    A shingle has two pivots: the label of most sets, as what is apart is mostly linked to that one and would seldom meet it
    among many small labels, and another label in every turn. So there are no more than twice as many rows as postings, and
    none whose bitmaps rule out a link.
    """
    weights = labels.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    kinds = members.select("id", "gid").join(labels.select("id", "label"), "id").groupBy("gid", "label").agg(F.min_by("id", _by_turn("id", turn)).alias("id"))
    named = lists.join(kinds.join(weights, "label"), "gid").withColumn("o", F.struct(F.lit(0) if turn % 2 else -F.col("rest") / F.col("size"), F.xxhash64("id", "token", F.lit(str(turn)))))
    firsts = named.groupBy("token", "weight", "label").agg(F.min(F.struct("o", "id", "size", "rest")).alias("h")).select("token", F.struct("weight", "label", "h.id", "h.size", "h.rest").alias("f"))
    pivots = firsts.groupBy("token").agg(F.max("f").alias("most"), F.min_by("f", F.struct(_by_turn("f.label", turn), "f.label")).alias("other"), F.count(F.lit(1)).alias("labels"))
    pivots = pivots.where("labels > 1").select("token", F.explode(F.array_distinct(F.array("most", "other"))).alias("p"))
    met = firsts.join(pivots, "token").where((F.col("f.label") != F.col("p.label")) & _reaches(F.col("f.rest"), F.col("f.size"), F.col("p.rest"), F.col("p.size"), percent))
    met = met.select(F.least("f", "p").alias("f"), F.greatest("f", "p").alias("p"))
    met = met.select(F.col("f.label").alias("label"), F.col("p.label").alias("to"), F.col("p.weight").alias("weight"), F.col("p.id").alias("a"), F.col("f.id").alias("b")).distinct()
    own = sets.select("id", F.struct("n", *BITS).alias("bits"))
    both = met.join(own.toDF("a", "ba"), "a").join(own.toDF("b", "bb"), "b")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"ba.{b}").bitwiseXOR(F.col(f"bb.{b}"))) for b in BITS])
    both = both.withColumn("d", differ).where(F.col("d") * (100 + percent) <= (F.col("ba.n") + F.col("bb.n")) * (100 - percent))
    return both.groupBy("label", "to", "weight").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("label", "to", "weight", "m.a", "m.b")


def linked_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, label): for sets with candidates, one label for all that reach each other by links."""
    able = sets.where(F.col("tokens").isNotNull())
    groups = stored(able.groupBy("prefix_key", "n").agg(F.min("id").alias("gid"), *_known_bits()), "prefix-groups")
    members = stored(able.select("id", "prefix_key", "n").join(groups.select("prefix_key", "n", "gid"), ["prefix_key", "n"]).select("id", "n", "gid"), "group-members")
    heads = able.join(members.where("id = gid").select("id"), "id", "left_semi")
    shared = heads.select(F.posexplode("prefix").alias("at", "token"), F.col("id").alias("gid"), F.col("n").alias("size"), "alone")
    shared = stored(shared.select("token", "gid", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("rest")), "prefix-postings")

    # members against the head of their group
    inside = stored(verify(members.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b")), able, percent), "links")
    links = [inside]
    labels = _relabelled(members.select("id", "n", F.col("id").alias("label")), inside.select(F.col("b").alias("label"), F.col("a").alias("to")))
    # labels against the label that they meet most: behind every shingle one label, another in every turn, is the pivot;
    # who is linked to it takes its label, which unites chains over several turns and never joins what isn't linked
    for turn in range(MOST_ROUNDS):
        named = shared.join(labels.select(F.col("id").alias("gid"), "label"), "gid")
        firsts = named.groupBy("token", "label").agg(F.min(F.struct(_by_turn("gid", turn).alias("o"), "gid", "size", "rest")).alias("h")).select("token", "label", "h.gid", "h.size", "h.rest")
        pivots = firsts.groupBy("token").agg(F.min(F.struct(_by_turn("label", turn).alias("o"), "label", "gid", "size", "rest")).alias("p"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        met = firsts.join(pivots, "token").where((F.col("label") != F.col("p.label")) & _reaches(F.col("rest"), F.col("size"), F.col("p.rest"), F.col("p.size"), percent))
        often = met.groupBy("label", F.col("p.label").alias("to")).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("p.gid").alias("a"), F.col("gid").alias("b"))).alias("pair"))
        asked = stored(often.groupBy("label").agg(F.max_by(F.struct("to", "pair"), F.struct("times", -F.col("to"))).alias("m")).select("label", "m.to", "m.pair.a", "m.pair.b"), "asked")
        found = stored(verify(asked, able, percent), "links")
        links.append(found.select("a", "b"))
        labels = _relabelled(labels, found.select("label", "to"))
        n_asked = asked.count()
        if n_asked == 0 or found.count() * UNITED < n_asked:
            break
    lists = shared.unionByName(groups.select(F.xxhash64("gid").alias("token"), "gid", F.col("n").alias("size"), F.col("n").alias("rest")))
    for turn in range(WITNESS_ROUNDS):
        asked = stored(_witnesses(lists, members, labels, able, turn, percent), "asked")
        found = stored(verify(asked, able, percent), "links")
        links.append(found.select("a", "b"))
        labels = _relabelled(labels, found.groupBy("label").agg(F.max_by("to", F.struct("weight", "to")).alias("to")))
        if found.isEmpty():
            break
    labels = _united(members.select("id", "n", F.col("id").alias("label")), reduce(DataFrame.unionByName, links))

    # whatever is still apart: labels behind one shingle (or in one group), then their groups, then the members
    parts = members.join(labels.select("id", "label"), "id").select("gid", "label", "n", "id")
    kinds = parts.select("gid", "label", F.col("n").alias("size")).distinct()
    named = stored(lists.drop("size").join(kinds, "gid"), "named-postings")
    apart = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    behind = stored(named.join(apart, "token", "left_semi").join(groups.select("gid", _bits_struct("bits")), "gid"), "apart")
    # a pair of sets is found behind its first common shingle, so others may be passed over; of a label the best case counts
    best = behind.groupBy("token", "label").agg(F.count(F.lit(1)).alias("groups"), F.max("rest").alias("rest"), F.min("size").alias("size"),
                                              F.max("size").alias("most"), *_same_bits(lambda b: F.col(f"bits.{b}")))
    best = best.select("token", "label", "groups", "rest", "size", "most", _bits_struct("bits"))
    met = best.toDF("token", "la", "ca", "ra", "na", "ma", "ba").join(best.toDF("token", "lb", "cb", "rb", "nb", "mb", "bb"), "token")
    # the label with fewer groups comes first and is expanded first
    met = met.where((F.struct("ca", "la") < F.struct("cb", "lb")) & _reaches(F.col("ra"), F.col("na"), F.col("rb"), F.col("nb"), percent)
                    & _alike("ba", "bb", F.col("ma"), F.col("mb"), percent)).select("token", "la", "lb")
    met = stored(met, "label-pairs")
    asked = met.select("token", F.col("la").alias("label")).unionByName(met.select("token", F.col("lb").alias("label"))).distinct()
    sides = behind.join(asked, ["token", "label"], "left_semi").join(heads.select(F.col("id").alias("gid"), "prefix"), "gid")
    sides = stored(sides.select("token", "label", "gid", "size", "rest", "prefix", "bits"), "pair-sides")
    one = met.join(sides.toDF("token", "la", "ga", "sa", "ra", "pa", "ba"), ["token", "la"])
    two = one.join(sides.toDF("token", "lb", "gb", "sb", "rb", "pb", "bb"), ["token", "lb"])
    first = F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("token")  # prefixes are in one order
    fits = _reaches(F.col("ra"), F.col("sa"), F.col("rb"), F.col("sb"), percent)
    group_pairs = two.where(fits & _alike("ba", "bb", F.col("sa"), F.col("sb"), percent) & ((F.col("ga") == F.col("gb")) | first)).select("ga", "la", "gb", "lb").distinct()
    own = able.select("id", F.struct(*[c.alias(f"{p}{b}") for b in BITS for p, c in (("one_", F.col(b)), ("no_", F.bitwise_not(b)))]).alias("bits"))
    of = parts.join(own, "id").select("gid", "label", "id", "n", "bits")
    rest = group_pairs.join(of.toDF("ga", "la", "a", "na", "ba"), ["ga", "la"]).join(of.toDF("gb", "lb", "b", "nb", "bb"), ["gb", "lb"])
    rest = rest.where(_alike("ba", "bb", F.col("na"), F.col("nb"), percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _united(labels, stored(verify(rest, able, percent), "links")).select("id", "label")


def text_groups(docs: DataFrame, key: str, text: str, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(digest, n, doc, component, stays) of every distinct text: its set size, its smallest key, the smallest key of its
    group, and whether it is the text that stands for the group (of the smallest key, then digest)."""
    def found() -> DataFrame:
        sets = stored_alone(lambda: candidate_sets(pack_blocks(distinct_texts(docs, key, text)), size, percent), "sets")
        linked = stored(linked_sets(sets, percent).join(sets.select("id", "doc", "digest"), "id"), "linked")
        smallest = linked.groupBy("label").agg(F.min("doc").alias("component"), F.min(F.struct("doc", "digest")).alias("head"))
        linked = linked.join(smallest, "label").select("id", "component", (F.col("head.digest") == F.col("digest")).alias("stays"))
        every = sets.select("id", "doc", "digest", "n").join(linked, "id", "left")
        return every.select("digest", "n", "doc", F.coalesce("component", "doc").alias("component"), F.coalesce("stays", F.lit(True)).alias("stays"))

    return stored_alone(found, "text-groups")


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links, itself included).

    Null and empty texts and those without words have an empty set, are linked with nothing and are their own component.
    Rows without a key count as larger than all others: their component is the smallest key linked with them, or null.
    Repeated rows and copies share one component. Other columns are not read. Shingles are compared by 64-bit hashes.
    """
    found = text_groups(docs, key, text, size, percent).select("digest", "n", "component")
    rows = docs.select(F.col(key).alias("_key"), _digest(text).alias("digest"))
    out = rows.join(found, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("_key")).when(F.col("component") < NO_KEY, F.col("component"))
    return out.select(F.col("_key").alias(key), F.coalesce("n", F.lit(0)).alias("n_shingles"), component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of linked documents: that with the smallest key.

    Rows without words all stay. Of rows that repeat the key and text one stays. All columns are returned.
    """
    found = text_groups(docs, key, text, size, percent).where("stays and n > 0").select(F.col("digest").alias("_digest"), F.col("doc").alias("_doc"))
    worded = F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    rows = docs.where(worded).select(F.struct("*").alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key"), _digest(text).alias("_digest"))
    kept = rows.join(found, "_digest").where(F.col("_key") == F.col("_doc")).dropDuplicates(["_digest"])
    return kept.select("_row.*").unionByName(docs.where(~worded))
