"""The pipeline against a plain version of its stages."""

import hashlib

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from laminaflow.llm import pii_contexts, queries


def test_stages_return_the_columns(spark, docs, tmp_path_factory):
    """Every stage takes rows with nulls, ties and clashing columns, and all but the last return the same columns."""
    sf_dir = "/root/testdata/sf0.001"
    rows = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, rows, sf_dir).write.parquet(path)
        again = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert again.columns == docs.columns
        rows = again
    assert rows.count() > 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, stage):
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 0").withColumns({c: F.lit("x") for c in ("_row", "_k", "_h", "_key", "spans")})
    got = stage(spark, empty, "/root/testdata/sf0.001")
    assert got.count() == 0 and (got.columns == empty.columns or "ids" in got.columns)


def test_unknown_languages_and_noise_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = docs.where("lang in ('en', 'de')")
    short = [(-k, "the " + w, None) for k, w in enumerate(("and in", "of thing that", "to her"), 1)]
    odd = [(-10, "日本語 テキスト です " * 20, None), (-11, "qzxv wkjq xxzq vvkq jqzx " * 20, None), (-12, "zqxj kvwq", None)]
    given = known.unionByName(docs.where("lang in ('es', 'fr')").withColumn("lang", F.lit(None).cast("string"))).unionByName(spark.createDataFrame(short + odd, known.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, given, "").collect()}
    told = {r.doc_id for r in known.collect() if any(c.isalpha() for c in r.text or "")}
    assert told - kept == set() and kept - told == {r[0] for r in short}


def test_pipeline_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = {r.doc_id: r for r in queries.op6_language_id(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if told[r.doc_id].lang_pred != "und" and told[r.doc_id].score >= corpus_pipeline.LEAST_SCORE]
    rows = [r for r, (i, n, c) in zip(rows, brute.near_duplicates(rows)) if not n or c == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r, found in zip(rows, brute.contamination(rows, items)) if not found[5]]
    masked = pii_contexts.without_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in masked:
        assert not brute.personal_data(r.text)
    wanted = {(i, n, decoded) for i, n, _, decoded in brute.sentencepiece_rows([(r.doc_id, r.text) for r in masked])}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got} == wanted and len(got) == len(wanted)
    assert all(len(r.ids) == r.n_tokens for r in got)
