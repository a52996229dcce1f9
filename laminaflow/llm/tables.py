"""Reading tables, writing intermediate ones, and small column helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from laminaflow.session import prepare, shared_dir

#: Rows and bytes of one Arrow batch handed to Python, so that long texts cannot pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Folders written inside the innermost ``stored_alone``.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the session deletes it when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _hadoop(spark, path)[0].deleteOnExit(_hadoop(spark, path)[1])
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)


def discard(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def write_once(df: DataFrame, name: str) -> str:
    """Writes ``df`` to a new shared folder and frees the shuffle files of that job; returns the path."""
    spark = df.sparkSession
    path, before = folder(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: lineage is cut and lost executors cannot change its rows."""
    path = write_once(df, name)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, stored; the tables that ``build`` stored on its way are deleted after that."""
    outer, paths = _passing.get(), []
    _passing.set(paths)
    try:
        df = build()
    finally:
        _passing.set(outer)
    out = stored(df, name)
    for path in paths:
        discard(df.sparkSession, path)
    return out


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for a kernel that yields dicts of equally long columns."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in kernel(batches):
            yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in fields], schema=fields)
        release()

    return df.mapInArrow(run, kind)


def release() -> None:
    """Gives what a kernel has freed back to the machine: workers stay, and run other stages later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def as_arrow(column, kind: pa.DataType) -> pa.Array:
    return column if isinstance(column, pa.Array | pa.ChunkedArray) and column.type == kind else column.cast(kind) if isinstance(column, pa.Array | pa.ChunkedArray) else pa.array(column, kind)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The strings of a column, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` where the text has no other letters to change."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(col.rlike("[^\\x00-\\x7F]"), F.translate(col, upper, lower)).otherwise(F.lower(col))
