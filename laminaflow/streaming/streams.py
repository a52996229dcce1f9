"""Streaming forms. Each agrees with its batch counterpart on complete input.

Functions take and return (streaming) DataFrames; ``drain`` runs one to the end of the available input.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from laminaflow.functions.scalars import to_number
from laminaflow.operators.sessions import gap_sessions
from laminaflow.session import materialize, shared_dir
from laminaflow.sources import files

# the process that prepares stateful operators gets no files of the application, so they travel with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIVE_SECONDS = 300
#: What may say where a frame stands in its source.
PLACES = ("place", "line_no")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                      files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def read_line_stream(spark: SparkSession, path: str, glob: str = "*.log", files_per_trigger: int = 1000) -> DataFrame:
    """New log files as lines with their source; every file is handed over once (checkpointed source)."""
    raw = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", files_per_trigger).text(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("mtime"),
                      F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("place"), F.col("value").alias("line"))


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over everything available into a parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        query = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def sensor_frames(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """Sensor lines of a known header as one typed row each; header repeats and short lines drop out.

    ``place`` or ``line_no`` of a line, what says where it stands in its source, goes with it.
    """
    cells = F.split("line", r"\|", -1)
    cols = [F.get(cells, F.lit(i)) for i in range(len(header))]
    typed = [F.trim(c).alias(h) if h == "Time" else to_number(c).alias(h) for h, c in zip(header, cols)]
    out = lines.where(F.contains("line", F.lit("|"))).select("source", "mtime", *[c for c in PLACES if c in lines.columns], *typed)
    seen = [F.col(f"`{h}`").isNotNull() for h in header if h in ("SO1", "SO2", "ST5")]
    any_seen = seen[0]
    for s in seen[1:]:
        any_seen = any_seen | s
    return out.where(any_seen)


def tail_lines(spark: SparkSession, path: str, seen: DataFrame | None = None, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines that files gained since the last call, and how far each file has been read (path, upto).

    The file source of a stream hands every file over once; this form also follows files that grow. Call it from a
    trigger (``hand_over`` of a rate source, say) with what the call before returned. A last line without its end is left
    for the next call. A file that became shorter is read anew.
    """
    lines = files.read_lines(spark, path, glob=glob)
    ends = lines.groupBy("path").agg(F.max_by(F.col("offset") + F.col("n_bytes"), "line_no").alias("end"))
    if seen is not None:
        ends = ends.join(seen.select("path", F.col("upto").alias("_upto")), "path", "left")
        ends = ends.withColumn("_upto", F.when(F.col("_upto") <= F.col("end"), F.col("_upto")).otherwise(F.lit(0)))
        lines = lines.join(ends.select("path", "_upto"), "path").where("offset >= _upto").drop("_upto")
    # written now: the files will have grown when the next call looks at it
    return lines.withColumn("source", F.col("path")), materialize(ends.select("path", F.col("end").alias("upto")), "tail")


def live_tail(frames: DataFrame) -> DataFrame:
    """Latest frame per source (update mode, a trigger of about two seconds): the one that stands last in its source.

    Frames need a ``place`` or ``line_no``. Clocks decide nothing, as they start again at midnight.
    """
    rest = [c for c in frames.columns if c != "source"]
    places = [c for c in PLACES if c in rest]
    if not places:
        raise ValueError("frames need a place or line_no")
    frame = F.struct(*[F.col(f"`{c}`") for c in rest])
    return frames.groupBy("source").agg(F.max_by(frame, F.struct("mtime", places[0])).alias("_f")).select("source", "_f.*")


def latest_frames(frames: DataFrame, name: str) -> DataFrame:
    """Drains a stream of frames in update mode and keeps each source's last update."""
    updates = drain_updates(live_tail(frames), name)
    last = Window.partitionBy("source").orderBy(F.desc("_batch"))  # a row per source and micro-batch
    return updates.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_batch")


def drain_updates(df: DataFrame, name: str) -> DataFrame:
    """Like ``drain`` for update mode: all updates, tagged with the micro-batch (``_batch``) they belong to."""
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema.add("_batch", T.IntegerType())).option("recursiveFileLookup", True).parquet(f"{base}/out")


def live_alarm(frames: DataFrame, oxygen_high: float, temperature_high: float) -> DataFrame:
    """Frame plus alarm flag; a missing value counts as 0."""
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in frames.columns else F.lit(0.0)
    hit = (v("SO1") > oxygen_high) | (v("SO2") > oxygen_high) | (v("ST5") > temperature_high)
    return frames.withColumn("alarm", hit)


def reading_alarms(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """Stateless stream-static join: long readings beyond their signal's limits."""
    hit = (F.col("value") > F.col("alarm_high")) | (F.col("value") < F.col("alarm_low"))
    return readings.join(F.broadcast(limits.select("signal", "alarm_low", "alarm_high")), "signal").where(hit)


def stream_dedup(events: DataFrame, keys: Sequence[str], delay: str = "10 minutes", bucket: str = "2 seconds") -> DataFrame:
    """First event per tumbling bucket and key, emitted once the watermark has passed the bucket."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", bucket).alias("w"), *keys)
            .agg(F.min("event_id").alias("event_id"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("copies"))
            .select(F.col("w.start").alias("bucket_start"), *keys, "event_id", "confidence", "copies"))


def stream_sessions(events: DataFrame, keys: Sequence[str], gap: str = "36 hours", delay: str = "1 hour") -> DataFrame:
    """Closed idle-gap sessions."""
    return (events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("end_ts"))
            .select(*keys, F.col("w.start").alias("start_ts"), "end_ts", "events"))


def with_open_sessions(closed: DataFrame, events: DataFrame, keys: Sequence[str], gap: str = "36 hours") -> DataFrame:
    """The drained sessions and those that the watermark has not closed yet, told apart by ``open``."""
    last = closed.groupBy(*keys).agg(F.max("end_ts").alias("_last"))
    rest = events.join(last, list(keys), "left").where("_last is null or ts > _last")
    numbered = gap_sessions(rest.select(*keys, "ts"), keys, "ts", [], gap)
    open_ = numbered.groupBy(*keys, "session_no").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("events"))
    return closed.withColumn("open", F.lit(False)).unionByName(open_.drop("session_no").withColumn("open", F.lit(True)))


def with_open_buckets(closed: DataFrame, events: DataFrame, keys: Sequence[str], bucket: str = "2 seconds") -> DataFrame:
    """The drained buckets and those that the watermark has not closed yet, told apart by ``open``.

    Events without a stamp are in no bucket; a stream can't tell when they are complete, so each stays on its own.
    """
    rows = events.where("ts is not null").groupBy(F.window("ts", bucket).alias("w"), *keys).agg(
        F.min("event_id").alias("event_id"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("copies"))
    rows = rows.select(F.col("w.start").alias("bucket_start"), *keys, "event_id", "confidence", "copies")
    open_ = rows.join(closed.select("bucket_start", *keys), ["bucket_start", *keys], "left_anti")
    bare = events.where("ts is null").select(F.lit(None).cast("timestamp").alias("bucket_start"), *keys, "event_id", "confidence", F.lit(1).cast("long").alias("copies"))
    return closed.withColumn("open", F.lit(False)).unionByName(open_.unionByName(bare).withColumn("open", F.lit(True)))


class _Liveness(StatefulProcessor):
    """Announces a source as live when it is first touched and as idle when nothing came for the limit."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timers.getCurrentProcessingTimeInMs()
        fresh = not self.due.exists()
        if not fresh:
            self.handle.deleteTimer(self.due.get()[0])
        due = now + self.seconds * 1000
        self.due.update((due,))
        self.handle.registerTimer(due)
        if fresh:
            yield pd.DataFrame({"source": [key[0]], "status": ["live"]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield pd.DataFrame({"source": [key[0]], "status": ["idle"]})

    def close(self) -> None:
        pass


def source_liveness(frames: DataFrame, seconds: int = LIVE_SECONDS) -> DataFrame:
    """live / idle changes per source, by a processing-time timer (needs the RocksDB state store)."""
    return frames.select("source").groupBy("source").transformWithStateInPandas(
        statefulProcessor=_Liveness(seconds), outputStructType="source string, status string",
        outputMode="Append", timeMode="ProcessingTime")


class _RunLength(StatefulProcessor):
    """State changes of a source across micro-batches; clocks carried over midnight on the way."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state array<string>, since timestamp, raw timestamp, days int")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        # a micro-batch bounds what one source brings at a time
        pdf = pd.concat(list(rows)).sort_values("line_no")
        state, since, raw, days = self.last.get() if self.last.exists() else (None, None, None, 0)
        naive = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t).tz_localize(None)
        since, raw, out = naive(since), naive(raw), []
        for line, ts, now in zip(pdf["line_no"], pdf["ts"], pdf["state"]):
            ts, now = naive(ts), list(now)
            if ts is not None:
                if raw is not None and ts + pd.Timedelta(hours=12) < raw:
                    days += 1
                raw, ts = ts, ts + pd.Timedelta(days=days)
            if state is None or now != state:
                if state is not None:
                    out.append((key[0], line, since, ts, state, now))
                state, since = now, ts
        self.last.update((state, None if since is None else since.to_pydatetime(),
                          None if raw is None else raw.to_pydatetime(), days))
        if out:
            yield pd.DataFrame(out, columns=["source", "line_no", "ts_start", "ts_end", "previous_state", "new_state"])

    def close(self) -> None:
        pass


def stream_transitions(rows: DataFrame) -> DataFrame:
    """rows(source, line_no, ts, state) -> state changes; lines of a source must arrive in order over batches."""
    return rows.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_RunLength(),
        outputStructType="source string, line_no long, ts_start timestamp, ts_end timestamp, previous_state array<string>, new_state array<string>",
        outputMode="Append", timeMode="None")


def hand_over(df: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None], available_now: bool = True):
    """Each new row batch goes to ``deliver`` once; a failed delivery is retried from the checkpoint.

    ``deliver`` must be idempotent per batch id (``sinks.upsert`` is).
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()


def recompute_changed(changes: DataFrame, checkpoint: str, recompute: Callable[[DataFrame], None]):
    """Feeds the distinct changed session ids of every micro-batch to ``recompute``."""
    def batch(df: DataFrame, _: int) -> None:
        recompute(df.select("session_id").distinct())
    return hand_over(changes, checkpoint, batch)
