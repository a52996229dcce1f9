"""Session builder and the one place that knows where shared scratch tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "laminaflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator relies on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to the Python workers of this application, wherever it was imported from; once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(root):  # imported from a folder; from an archive it was shipped already
            archive = os.path.join(tempfile.mkdtemp(prefix="laminaflow-code-"), "laminaflow_code.zip")
            with zipfile.ZipFile(archive, "w") as out:
                for folder, _, names in os.walk(root):
                    for name in names:
                        if name.endswith(".py"):
                            path = os.path.join(folder, name)
                            out.write(path, os.path.relpath(path, os.path.dirname(root)))
            spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings needed for right results on a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private folder only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="laminaflow-")
    return _local_dirs[app]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint does, but columnar: later readers prune columns, and
    values that a recomputation could change (partition ids) are fixed for all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
