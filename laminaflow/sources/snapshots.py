"""Tables as snapshots: a write adds files and a manifest, and counts from the moment the manifest has its name.

    <table>/data/<id>/_p=<partition>/*.parquet     rows, never changed once written
    <table>/manifests/<number>.json                partitions and their folders, the schema, the ids of all batches so far

A writer that dies leaves files that no manifest names; readers never see them, and ``vacuum`` removes them. A batch whose
id is in the newest manifest is not written again, so a replay changes nothing. Two writers of one number: the rename of
the manifest refuses to replace a file, the second one gets ``Conflict`` and may try again on the new snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminaflow.functions.scalars import finite_or_null
from laminaflow.sources.sinks import merge_latest

WHOLE = "all"


class Conflict(RuntimeError):
    """Another writer has finished a snapshot since this one began."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith((".", "_"))]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the newest by default; an empty one for a table that is not there yet."""
    have = versions(spark, path)
    if not have:
        return {"version": 0, "schema": None, "parts": {}, "batches": []}
    number = max(have) if version is None else version
    fs, at = _fs(spark, f"{path}/manifests/{number:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, new: dict) -> None:
    """Writes the manifest beside its place and renames it; the rename fails if the number is taken."""
    fs, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    _, temporary = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps(new).encode()))
    finally:
        out.close()
    _, final = _fs(spark, f"{path}/manifests/{new['version']:012d}.json")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(final), none)
    except Exception as exc:
        fs.delete(temporary, False)
        if fs.exists(final):
            raise Conflict(f"version {new['version']} of {path} exists") from exc
        raise


def _rows(spark: SparkSession, path: str, found: dict, parts: Sequence[str] | None = None) -> DataFrame | None:
    if not found["schema"]:
        return None
    schema = T.StructType.fromJson(found["schema"])
    folders = [f"{path}/data/{f}" for name, f in sorted(found["parts"].items()) if parts is None or name in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a version; it stays as it is while later ones are written."""
    rows = _rows(spark, path, manifest(spark, path, version))
    if rows is None:
        raise ValueError(f"no snapshot in {path}")
    return rows


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], version: Column, batch_id: str, partition_by: str | None = None) -> bool:
    """Merges a batch (newest row per key wins, see ``merge_latest``) as a new snapshot; False if the batch is in it already.

    With ``partition_by``, a column that the keys determine, only the partitions that the batch touches are read and
    written; the others keep their folders. The names of those partitions pass through the driver, nothing else does.
    """
    path = path.rstrip("/")
    now = manifest(spark, path)
    if batch_id in now["batches"]:
        return False
    batch = finite_or_null(incoming)
    place = F.lit(WHOLE) if partition_by is None else F.substring(F.sha2(F.coalesce(F.col(partition_by).cast("string"), F.lit("")), 256), 1, 16)
    touched = [f"_p={WHOLE}"] if partition_by is None else [f"_p={r.p}" for r in batch.select(place.alias("p")).distinct().collect()]
    old = _rows(spark, path, now, touched)
    merged = merge_latest(batch.limit(0) if old is None else old, batch, keys, version)
    name = uuid.uuid4().hex
    merged.withColumn("_p", place).write.partitionBy("_p").parquet(f"{path}/data/{name}")
    parts = {n: f"{name}/{n}" for n in _names(spark, f"{path}/data/{name}") if n.startswith("_p=")}
    _publish(spark, path, {"version": now["version"] + 1, "schema": merged.schema.jsonValue(), "parts": {**now["parts"], **parts}, "batches": [*now["batches"], batch_id]})
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes manifests but the newest ``keep`` and data folders that none of these names; returns how many folders.

    Not to be run while a writer is at work: its files have no manifest yet.
    """
    path = path.rstrip("/")
    have = versions(spark, path)
    kept = {f.split("/")[0] for v in have[-keep:] for f in manifest(spark, path, v)["parts"].values()}
    for v in have[:-keep]:
        fs, at = _fs(spark, f"{path}/manifests/{v:012d}.json")
        fs.delete(at, False)
    gone = [n for n in _names(spark, f"{path}/data") if n not in kept]
    for n in gone:
        fs, at = _fs(spark, f"{path}/data/{n}")
        fs.delete(at, True)
    return len(gone)
