"""Personal data by patterns and by bootstrapped contexts, with DataFrame functions only.

Entities that strict patterns find are seeds. The words before a seed are a lexical pattern of its kind. Looser shapes of
the same kinds are further instances. Patterns and instances form a weighted graph: a pattern is as trustworthy as the
instances it introduces, an unseen instance as the patterns that introduce it; both scores are computed in turns. What a
trusted pattern introduces with a high score is new personal data. All work is joins and sums over counted pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminaflow.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
# Each pattern starts only where the plain one's leftmost match can start and takes what it takes, without backtracking,
# so that long runs of letters, digits or dots stay linear.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser shapes: an address written out or without a dot, a colon address, separated long digit groups, local numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){0,8}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ .-])[0-9](?:[ .-]?[0-9]){12,18}+(?![ .-]?[0-9])",
    "phone": r"(?<![0-9+(])(?<![0-9+(][ .-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![ .-]?[0-9])",
}
#: A text without these has no match.
GATE = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: The last two words before a match, or the only one since the start of the text; an earlier match counts as one word.
CONTEXT = r"(?:^|\s)((?:\S{1,24}\s+)?\S{1,24})\s*$"
ROUNDS, LEAST_SEEDS, TRUST = 3, 5, 0.8


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.length(_digits(hit))
    return (F.when(kind == "ip", F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255))
            .when(kind == "card", F.expr("luhn_check(regexp_replace(hit, '[^0-9]', ''))"))
            .when(kind == "phone", digits.between(9, 15)).otherwise(F.lit(True)))


def matches(docs: DataFrame) -> DataFrame:
    """(_key, _hash, kind, strict, start, stop, hit, context) of all matches in ``docs`` (_key, _hash, _text).

    Places are counted in code points: the pieces between matches and the matches are measured and summed up.
    """
    def found(kind: str, pattern: str, strict: bool) -> Column:
        text = F.col("_text")
        return F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")).alias("parts"))

    with_any = docs.where(F.col("_text").rlike("|".join(dict.fromkeys(GATE.values()))))
    per_kind = [F.when(F.col("_text").rlike(GATE[k]), found(k, p, strict)) for strict, of in ((True, BASE), (False, LOOSE)) for k, p in of.items()]
    rows = with_any.select("_key", "_hash", F.explode(F.array(*per_kind)).alias("f")).where("f is not null and size(f.parts) > 1")
    rows = rows.select("_key", "_hash", "f.kind", "f.strict", F.posexplode("f.parts").alias("i", "part"))
    before = F.concat(F.when(F.col("i") > 0, F.concat(F.lit("<"), "kind", F.lit(">"))).otherwise(""), F.col("part.gap"))
    context = F.regexp_replace(F.lower(F.regexp_extract(F.right(before, F.lit(60)), CONTEXT, 1)), r"\s+", " ")
    rows = rows.select("_key", "_hash", "kind", "strict", "i", F.char_length("part.gap").alias("gap"), F.col("part.hit").alias("hit"), context.alias("context")).where("hit is not null")
    rows = stored(rows.dropDuplicates(["_key", "_hash", "kind", "strict", "i"]), "pii-matches")
    in_order = Window.partitionBy("_key", "_hash", "kind", "strict").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.char_length("hit")).over(in_order)
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.char_length("hit"))
    return rows.where(~F.col("strict") | _valid(F.col("kind"), F.col("hit"))).select("_key", "_hash", "kind", "strict", "start", "stop", "hit", "context")


def _free(found: DataFrame) -> DataFrame:
    """Loose matches that touch no strict one of their document."""
    whole = Window.partitionBy("_key", "_hash").orderBy("start", "strict")
    last = F.max(F.when(F.col("strict"), F.col("stop"))).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("strict"), F.col("start"))).over(whole.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumns({"last": F.coalesce(last, F.lit(-1)), "next": following})
    return marked.where(~F.col("strict") & (F.col("last") <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("stop")))).drop("last", "next")


def scored_graph(seeds: DataFrame, loose: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (kind, context, trust) and unseen instances (kind, hit, score) after the given rounds.

    A pattern starts from the share of seeds among the distinct instances that it introduces; fewer than ``least_seeds``
    different seeds make no pattern. An instance's score is the chance that not all its patterns are wrong.
    """
    edges = seeds.select("kind", "context", "hit", F.lit(1.0).alias("seed")).unionByName(loose.select("kind", "context", "hit", F.lit(0.0).alias("seed"))).where("context <> ''")
    edges = edges.groupBy("kind", "context", "hit").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("uses"))
    enough = edges.groupBy("kind", "context").agg(F.sum("seed").alias("seeds")).where(F.col("seeds") >= least_seeds).select("kind", "context")
    edges = stored(edges.join(enough, ["kind", "context"]), "pii-edges")
    score = edges.groupBy("kind", "hit").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        weighted = edges.join(score, ["kind", "hit"])
        trust = stored(weighted.groupBy("kind", "context").agg((F.sum("score") / (F.count(F.lit(1)) + 0.5)).alias("trust")), "pii-trust")
        # 1 - product of (1 - trust), as a sum of logarithms
        doubt = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999))))
        score = edges.join(trust, ["kind", "context"]).groupBy("kind", "hit").agg(F.max("seed").alias("seed"), (1 - F.exp(doubt)).alias("s"))
        score = stored(score.select("kind", "hit", F.greatest("seed", "s").alias("score")), "pii-score")
    return trust, score


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_trust: float = TRUST) -> DataFrame:
    """(_key, _hash, base, spans) of every document with personal data; spans are structs (rank, kind, start, stop).

    ``rank`` is the kind's place in KINDS; base holds what the strict patterns find, spans that and what the contexts
    add. Both are ordered by rank and start. A document is a key with a text (by its 64-bit hash): rows that repeat both are one.
    """
    keyed = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    found = stored(matches(keyed), "pii-found")
    loose = stored(_free(found), "pii-loose")
    trust, score = scored_graph(found.where("strict"), loose, rounds, least_seeds)
    trusted = trust.where(F.col("trust") >= least_trust).select("kind", "context")
    likely = score.where(F.col("score") >= least_trust).select("kind", "hit")
    added = loose.join(trusted, ["kind", "context"], "left_semi").join(likely, ["kind", "hit"], "left_semi")
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(KINDS.index(k))), KINDS[1:], F.when(F.col("kind") == KINDS[0], F.lit(0)))
    every = found.where("strict").select("_key", "_hash", "kind", "start", "stop", F.lit(True).alias("strict")).unionByName(added.select("_key", "_hash", "kind", "start", "stop", F.lit(False).alias("strict")))
    span = F.struct(rank.alias("rank"), "kind", "start", "stop")
    return every.groupBy("_key", "_hash").agg(F.array_sort(F.collect_list(F.when(F.col("strict"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(_row, base, spans) for every row of ``rows`` (_row, _key, _hash), with empty arrays where there are none.

    What the caller needs of a row travels in the struct ``_row``, so no name can clash, and a text only if it is in there.
    The join is a merge at every size, so a larger table has the same plan.
    """
    right = spans.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "base", "spans")
    joined = rows.join(right.hint("merge"), rows["_key"].eqNullSafe(F.col("_k")) & (rows["_hash"] == F.col("_h")), "left")
    empty = F.array().cast(spans.schema["base"].dataType)
    return joined.select("_row", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def hashed_rows(docs: DataFrame, row: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, _key, _hash) of every row of ``docs``."""
    return docs.select(row.alias("_row"), docs[key].alias("_key"), F.xxhash64(docs[text]).alias("_hash"))


def without_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with every span of personal data masked in the text.

    Null texts and keys stay null; repeated rows are masked alike. Columns of any name pass through unread.
    """
    found = with_spans(hashed_rows(docs, F.struct("*"), key, text), personal_data(docs, key, text))
    return found.select(F.col("_row").withField(f"`{text}`", masked(F.col("_row")[text], F.col("spans"))).alias("_row")).select("_row.*")


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with a tag like <EMAIL> in place of every span; of overlapping spans the first stays, grown over the others."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.upper(s["kind"]).alias("kind"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = F.concat(F.substring(text, state["at"].cast("int") + 1, F.greatest(s["start"] - state["at"], F.lit(0)).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(state["at"], s["stop"]).cast("long").alias("at"), F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(new))).otherwise(state["out"]).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"].cast("int") + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, first, step, finish)).otherwise(text)
