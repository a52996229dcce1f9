"""A training-data pipeline over ``documents``: language, near duplicates, decontamination, personal data, tokens.

Every stage gets all that its predecessor kept, as a table that was written and read again. All stages take empty tables
(and return empty ones), null keys, texts of any length, repeated rows and columns of any further names, which pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow.llm.jaccard_groups import without_near_duplicates
from laminaflow.llm.language_id import fit, identify, like_labelled
from laminaflow.llm.pii_contexts import without_personal_data
from laminaflow.llm.piece_spans import decode_pieces, encode_pieces
from laminaflow.llm.positional_index import without_contaminated
from laminaflow.llm.queries import PIECE_MODEL, held_out
from laminaflow.llm.tables import stored, table

#: A text whose best language is less probable than this among those known is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach: no text that is far less probable there than the labelled ones.

    Null texts and texts without a letter go; repeated rows are judged alike.
    """
    model = fit(docs.where(~held_out(docs)), PIECE_MODEL)
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.when(~held_out(docs), F.col("lang")).alias("_label"))
    found = stored(identify(rows, model, "_row", "_text", ("_label",)), "language-scores")
    return like_labelled(found, "_label", "_row.text").where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest key; of repeated rows one stays, texts without words all stay."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null and empty texts hold none and stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text (0 for null), null texts stay null."""
    masked = without_personal_data(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): SentencePiece ids of every text, and a digest of what they decode to; null is the empty text."""
    pieces = encode_pieces(docs, PIECE_MODEL).select("doc_id", "ids")
    return decode_pieces(pieces, PIECE_MODEL).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: SQL has no language model and no tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
