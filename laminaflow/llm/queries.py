"""The registered queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow.llm.compression_rules import compression_quality
from laminaflow.llm.jaccard_groups import near_duplicates
from laminaflow.llm.language_id import fit, identify
from laminaflow.llm.line_bitmaps import kept_lines
from laminaflow.llm.oracles import SQL  # noqa: F401
from laminaflow.llm.pii_contexts import KINDS, hashed_rows, personal_data, spans_text, with_spans
from laminaflow.llm.piece_spans import decode_pieces, encode_pieces
from laminaflow.llm.positional_index import contamination
from laminaflow.llm.style_tree import extract_text
from laminaflow.llm.suffix_dedup import dedup_documents
from laminaflow.llm.tables import table
from laminaflow.llm.token_links import link_counts
from laminaflow.llm.token_pack import read_token_files, write_token_files
from laminaflow.llm.turn_repair import damaged, repair_digests
from laminaflow.llm.warc_shards import read_warc, write_warc

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``covered_bytes`` sums the spans of the pieces: all bytes of the text."""
    pieces = encode_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL)
    decoded = decode_pieces(pieces, PIECE_MODEL)
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, n: total + n)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("covered_bytes"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(spark, base, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out(docs: DataFrame) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs)), PIECE_MODEL)
    return identify(docs, model).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, manifest = write_token_files(table(spark, sf_dir, "documents"), BYTE_MODEL, END_ID)
    return read_token_files(spark, base, manifest, ids=False)


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_spans(hashed_rows(docs, F.col("doc_id")), personal_data(docs))
    count = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("_row").alias("doc_id"), *count, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches; a query of its own, as the SQL of op10_positional_index fixes the columns there."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "contaminated", "n_near", F.array_join("near_items", ",").alias("near_items"), "near")


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_digests(damaged(rows), rows)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_compression_bands, op3_ngram_jaccard, op4_sentencepiece, op5_warc, op6_language_id, op7_token_files,
    op8_contextual_pii, op9_style_tree, op10_positional_index, op10_proximity_matches,
    op11_line_bitmaps, op12_turn_repair, op13_token_links)}
