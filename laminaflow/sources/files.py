"""Folder scan, file inspection, classification, manifests and the stability gate."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow.functions.logtext import decode_line, guess_encoding, looks_binary, name_date
from laminaflow.functions.scalars import first_match, stable_id
from laminaflow.model import FILE_FAMILIES, SKIPPED_NAMES
from laminaflow.operators.ordered import Series

LISTING = "path string, size_bytes long, mtime timestamp"


def plain_path(path: Column) -> Column:
    """One spelling of a local path (the sources write file:/x, file:///x or /x)."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_id() -> Column:
    return F.substring(F.sha2(plain_path(F.col("path")), 256), 1, 16)


def _glob(pattern: str) -> str:
    return "^" + re.escape(pattern).replace(r"\*", ".*") + "$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _walk(root: str, recursive: bool) -> pd.DataFrame:
    """Files (and, one level deep, directories) below ``root``; what vanishes meanwhile is left out."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root)
    prefix = root[:len(root) - len(base)] if root.endswith(base) else ""
    found = fs.get_file_info(pafs.FileSelector(base, recursive=recursive, allow_not_found=True))
    keep = [i for i in found if i.type == pafs.FileType.File or (not recursive and i.type == pafs.FileType.Directory)]
    return pd.DataFrame({
        "path": [prefix + i.path for i in keep], "size_bytes": [i.size if i.is_file else -1 for i in keep],
        "mtime": pd.to_datetime([(i.mtime_ns or 0) // 1000 for i in keep], unit="us", utc=True)}).astype({"size_bytes": "int64"})


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per file under ``root``, empty and hidden ones included, which Spark's file sources leave out.

    The driver reads one directory level; the subfolders are listed by tasks. Contents are not opened.
    """
    root = re.sub("^file:/+", "/", root).rstrip("/")
    top = _walk(root, False)
    plain = spark.createDataFrame([(r.path, int(r.size_bytes), r.mtime.to_pydatetime()) for r in top[top.size_bytes >= 0].itertuples()], LISTING)
    folders = top[top.size_bytes < 0].path.tolist()
    if not folders:
        return with_names(plain, root)
    def run(batches):
        for pdf in batches:
            for folder in pdf["path"]:
                yield _walk(folder, True)
    spread = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), 1000))
    return with_names(plain.unionByName(spread.mapInPandas(run, LISTING)), root)


def with_names(df: DataFrame, root: str, skip: Sequence[str] = tuple(SKIPPED_NAMES)) -> DataFrame:
    """Adds name, path below ``root``, family, role, confidence, date in the name and the skip reason.

    ``skip`` names the patterns of files to leave out; pass none to have burn and temperature tables parsed too.
    """
    base = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
    name = file_name(F.col("path"))
    return classify_files(df.select(
        "*", name.alias("name"),
        F.regexp_replace("path", "^(?:[a-z0-9]+:)?/*" + re.escape(base.lstrip("/")), "").alias("relative_path"),
        name_date(name).alias("name_date"),
        skip_reason(name, skip).alias("skip_reason")))


def classify_files(df: DataFrame, name: str = "name") -> DataFrame:
    """Family, role and confidence by the first matching name pattern."""
    kinds = [(F.col(name).rlike(_glob(g)),
              F.struct(F.lit(f).alias("family"), F.lit(r).alias("role"),
                       F.lit(0.55 if g == "*.log" else 0.95).alias("confidence")))
             for g, f, r in FILE_FAMILIES]
    unknown = F.struct(F.lit("unsupported").alias("family"), F.lit("unknown").alias("role"),
                       F.lit(0.0).alias("confidence"))
    df = df.withColumn("_kind", first_match(kinds, unknown))
    return df.select(*[c for c in df.columns if c != "_kind"], "_kind.family", "_kind.role",
                     F.col("_kind.confidence").alias("classification_confidence"))


def skip_reason(name: Column, skip: Sequence[str] = tuple(SKIPPED_NAMES)) -> Column:
    """Why a file is not ingested, null when it is. Size is no reason."""
    found = [(name.rlike(_glob(g)), f"redundant file type: matches skip pattern '{g}'") for g in skip]
    return first_match(found) if found else F.lit(None).cast("string")


def split_skipped(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.where("skip_reason is null"), files.where("skip_reason is not null")


def inspect_files(spark: SparkSession, root: str, skip: Sequence[str] = tuple(SKIPPED_NAMES)) -> DataFrame:
    """Kept files with checksum, encoding guess and quality status (reads each content once)."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True).load(root)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content"))
    empty = list_files(spark, root).where("size_bytes = 0").select("path", "size_bytes", "mtime", F.lit(b"").alias("content"))
    df = with_names(raw.unionByName(empty), root, skip)
    binary = looks_binary(F.col("content"))
    status = first_match([(F.col("size_bytes") == 0, "zero_byte"), (binary, "binary_or_unknown")], "ok")
    return df.where("skip_reason is null").select(
        file_id().alias("file_id"), plain_path(F.col("path")).alias("path"), "relative_path", "name", "family", "role",
        "classification_confidence", "size_bytes", "mtime", "name_date",
        F.sha2("content", 256).alias("checksum"), status.alias("quality_status"),
        F.when(status == "ok", guess_encoding(F.col("content"))).alias("encoding"))


def checksum_manifest(files: DataFrame) -> DataFrame:
    return files.select("relative_path", "checksum")


def read_lines(spark: SparkSession, path: str | list[str], encodings: DataFrame | None = None,
               glob: str | None = None) -> DataFrame:
    """Text lines with file id, 1-based line number and byte offset.

    Files are split freely. Inside a file the order is (block start, position in the scan), numbered by the
    chunked kernel, so one huge log is not pulled into one task. The bytes are decoded line by line; pass
    ``encodings`` (path, encoding) to use the per-file guess.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), "value")
    raw = raw.withColumn("_bytes", F.octet_length("value").cast("long") + 1)
    numbered = (
        Series(raw, ["path"], ["_block", "_seq"])
        .with_row_number("line_no").with_running_sum("_end", F.col("_bytes")).frame)
    encoding = None
    if encodings is not None:
        numbered = numbered.join(encodings.select("path", "encoding"), "path", "left")
        encoding = F.col("encoding")
    return numbered.select(
        file_id().alias("source_file_id"), "path", "name", name_date(F.col("name")).alias("day"), "mtime",
        "line_no", (F.col("_end") - F.col("_bytes")).alias("offset"), F.col("_bytes").alias("n_bytes"),
        decode_line(F.col("value"), encoding).alias("line"))


def lines_of_content(files: DataFrame) -> DataFrame:
    """Numbered lines of a (source_file_id, text) table, for texts already held in a column."""
    parts = files.select("*", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    last_empty = (F.col("_line") == "") & (F.col("_pos") == F.size(F.split("text", "\n", -1)) - 1)
    return parts.where(~last_empty).select(
        *[c for c in files.columns if c != "text"],
        (F.col("_pos") + 1).cast("long").alias("line_no"), F.rtrim("_line", F.lit("\r")).alias("line"))


def snapshot(files: DataFrame) -> DataFrame:
    """Listing reduced to what the stability gate compares."""
    return files.select("relative_path", "size_bytes", "mtime")


def stability(current: DataFrame, previous: DataFrame | None, as_of: Column, min_age_seconds: float = 60.0) -> DataFrame:
    """One row (stable, reason) for a drop folder from two listing snapshots."""
    now = current.agg(
        F.count(F.lit(1)).alias("n"),
        F.min((F.unix_micros(as_of) - F.unix_micros("mtime")) / F.lit(1e6)).alias("youngest"))
    if previous is None:
        diff = now.select(F.lit(0).cast("long").alias("changed"), F.lit(0).cast("long").alias("before"))
    else:
        a = current.select("relative_path", F.struct("size_bytes", "mtime").alias("a"))
        b = previous.select("relative_path", F.struct("size_bytes", "mtime").alias("b"))
        diff = a.join(b, "relative_path", "full").agg(
            F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count("b").alias("before"))
    reason = first_match([
        (F.col("n") == 0, "source_missing_or_empty"),
        (F.col("youngest") < min_age_seconds, "files_too_recent"),
        ((F.col("before") > 0) & (F.col("changed") > 0), "file_snapshot_changed")], "stable")
    # both sides are single-row aggregates
    return now.crossJoin(diff).select((reason == "stable").alias("stable"), reason.alias("reason"),
                                      F.col("n").alias("file_count"))


def unseen(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Incremental load: rows whose key is not stored yet."""
    return candidates.join(known.select(*keys).distinct(), keys, "left_anti")


def event_ids(events: DataFrame, index: str = "event_index") -> DataFrame:
    return events.withColumn("event_id", stable_id(F.col("source_file_id"), F.col(index).cast("string"),
                                                   prefix="event_"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
