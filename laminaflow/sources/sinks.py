"""Write side: idempotent upserts, incremental merge, exports, session reports, backfill."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow.functions.scalars import finite_or_null, stable_id
from laminaflow.operators.ordered import Series

# Export category -> tables.
EXPORT_CATEGORIES = {
    "operator": ["print_records", "print_record_files", "operator_events", "operator_journal_entries"],
    "sessions": ["sessions", "source_files", "import_jobs", "canonical_events", "state_transitions", "layer_snapshots", "segments"],
    "analytics": ["reports", "analysis_versions", "historical_analysis_verdicts", "pattern_insights", "confirmed_knowledge",
                  "hypotheses", "anomalies", "causal_links"],
    "models": ["parts", "build_jobs", "build_plates", "part_placements", "layer_ranges", "attachments"],
    "maintenance": ["maintenance_records", "component_state_timeline", "powder_preparation_events", "powder_usage_cycles",
                    "gas_cylinders", "material_batches", "machine_params", "machine_presets", "quality_outcomes", "tolerance_rules"],
}


def file_rows(files: DataFrame) -> DataFrame:
    """Stored form of inspected files: deterministic id from session and content."""
    return files.withColumn("source_file_id", stable_id(F.col("session_id").cast("string"), F.coalesce("checksum", "name"), prefix="file_"))


def event_rows(events: DataFrame, order: Sequence[str] = ("source_line", "entry_no")) -> DataFrame:
    """Stored form of events: id from file and position in the file, non-finite numbers nulled."""
    s = Series(events, ["source_file_id"], list(order)).with_row_number("_rn")
    out = s.frame.withColumn("event_id", stable_id(F.col("source_file_id"), (F.col("_rn") - 1).cast("string"), prefix="event_"))
    return finite_or_null(out.drop("_rn"))


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Union keeping the newest row per key (incoming wins ties).

    A column that only the stored rows have keeps its stored value, also where an incoming row wins; one that only the
    incoming rows have is null where a stored row wins.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    only_old = [c for c in existing.columns if c not in incoming.columns]
    cols = [c for c in both.columns if c != "_new" and c not in keys and c not in only_old]
    place = F.struct(version, F.col("_new"))
    aggs = [F.max_by(F.struct(*cols), place).alias("_r")]
    if only_old:
        aggs.append(F.max_by(F.struct(*only_old), F.when(F.col("_new") == 0, place)).alias("_o"))
    picked = both.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[F.col(f"_o.{c}" if c in only_old else f"_r.{c}").alias(c) for c in both.columns if c != "_new" and c not in keys])


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], version: Column,
           partition_by: str | None = None) -> None:
    """Idempotent write of a parquet table.

    With ``partition_by`` only the partitions the batch touches are read and replaced (dynamic overwrite); pick a
    column the keys determine. The merged rows are staged first, because a table cannot be overwritten while read;
    the stage goes when they are in place. Columns are the union of both sides (see ``merge_latest``).
    """
    batch = finite_or_null(incoming)
    old = batch.limit(0)
    if _has_data(spark, path):
        old = spark.read.option("mergeSchema", True).parquet(path)
        if partition_by:
            old = old.join(batch.select(partition_by).distinct(), partition_by, "left_semi")
    merged = merge_latest(old, batch, keys, version)
    stage = f"{path.rstrip('/')}__stage-{uuid.uuid4().hex}"
    merged.write.parquet(stage)
    staged = spark.read.schema(merged.schema).parquet(stage)
    writer = staged.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)
    fs, target = _hadoop(spark, stage)
    fs.delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _has_data(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def merge_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """First import wins for start and end, the payload is always the new one."""
    a, b = existing.alias("a"), incoming.alias("b")
    j = a.join(b, F.col("a.session_id") == F.col("b.session_id"), "full")
    return j.select(F.coalesce("a.session_id", "b.session_id").alias("session_id"),
                    F.coalesce("a.start_ts", "b.start_ts").alias("start_ts"), F.coalesce("a.end_ts", "b.end_ts").alias("end_ts"),
                    F.coalesce("b.payload", "a.payload").alias("payload"))


def export_tables(tables: dict[str, DataFrame], root: str, categories: Sequence[str] | None = None) -> list[str]:
    """JSON lines per table under root/category/table; unknown categories mean all of them."""
    chosen = [c for c in (categories or []) if c in EXPORT_CATEGORIES] or list(EXPORT_CATEGORIES)
    written = []
    for cat in chosen:
        for name in EXPORT_CATEGORIES[cat]:
            if name in tables:
                tables[name].write.mode("overwrite").json(f"{root}/{cat}/{name}")
                written.append(f"{cat}/{name}")
    return written


# Sections of a session report, in document order.
REPORT_SECTIONS = ["session_summary", "features", "file_inventory", "data_quality", "phase_segments", "layer_features",
                   "anomalies", "timeline", "version_metadata"]


def report_rows(sections: dict[str, tuple[DataFrame, Sequence[str]]], versions: dict[str, str] | None = None) -> DataFrame:
    """Session reports as JSON lines: (session_id, section_no, section, position, body).

    ``sections`` maps a section name to (rows, order columns). A report is the lines of its session in (section_no,
    position) order. It is never gathered into one row, because a session can hold any share of the data.
    """
    parts = []
    for name in REPORT_SECTIONS:
        if name not in sections:
            continue
        df, order = sections[name]
        body = F.to_json(F.struct(*[c for c in df.columns if c != "session_id"]))
        numbered = Series(df.select("session_id", *order, body.alias("body")), ["session_id"], list(order)).with_row_number("position")
        parts.append(numbered.frame.select("session_id", F.lit(REPORT_SECTIONS.index(name)).alias("section_no"), F.lit(name).alias("section"), "position", "body"))
    if versions:
        base = sections["session_summary"][0].select("session_id").distinct()
        meta = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in versions.items()]))
        no = len(REPORT_SECTIONS) - 1
        parts.append(base.select("session_id", F.lit(no).alias("section_no"), F.lit(REPORT_SECTIONS[no]).alias("section"), F.lit(1).cast("long").alias("position"), meta.alias("body")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown_rows(classes: DataFrame, files: DataFrame, segments: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Text reports as ordered lines: (session_id, section_no, position, line)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    sid = F.col("session_id").cast("string")
    heads = F.array(*[F.struct(F.lit(no).alias("section_no"), F.lit(p).cast("long").alias("position"), line.alias("line")) for no, p, line in [
        (0, 1, F.concat(F.lit("# Session Report: "), sid)), (0, 2, F.lit("## Summary")),
        (0, 3, F.concat(F.lit("- Classification: "), "classification", F.lit(" ("), text("confidence"), F.lit(")"))),
        (1, 0, F.lit("## File Inventory")), (2, 0, F.lit("## Timeline And Phases")), (3, 0, F.lit("## Anomalies"))]])
    out = classes.select("session_id", F.inline(heads))
    rows = [
        (1, files, ["relative_path"], F.concat(F.lit("- "), "relative_path", F.lit(": "), "family", F.lit(" / "), "role", F.lit(", "), text("size_bytes"), F.lit(" bytes, quality="), "quality_status")),
        (2, segments, ["segment_no"], F.concat(F.lit("- "), "phase", F.lit(": "), text("ts_start"), F.lit(" -> "), text("ts_end"))),
        (3, anomalies, ["anomaly_type", "layer"], F.concat(F.lit("- "), "anomaly_type", F.lit(": severity="), "severity", F.lit(", confidence="), text("confidence"))),
    ]
    for no, df, order, line in rows:
        s = Series(df.select("session_id", *order, line.alias("line")), ["session_id"], order).with_row_number("position")
        out = out.unionByName(s.frame.select("session_id", F.lit(no).alias("section_no"), "position", "line"))
    quiet = classes.join(anomalies.select("session_id").distinct(), "session_id", "left_anti")
    return out.unionByName(quiet.select("session_id", F.lit(3).alias("section_no"), F.lit(1).cast("long").alias("position"),
                                        F.lit("- No deterministic anomalies were generated.").alias("line")))


def write_reports(rows: DataFrame, path: str, body: str, files: int = 200) -> None:
    """Text files with the lines of each session together and in order; a long session may span files."""
    order = ["session_id", "section_no", "position"]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select(
        F.to_json(F.struct(*order, body))).write.mode("overwrite").text(path)


def evidence_rows(events: DataFrame, order: Sequence[str], limit: int, key: str = "session_id") -> DataFrame:
    """First ``limit`` events of each session, reduced to what a reviewer needs; ``total`` says how many there are."""
    fields = [c for c in ("ts", "layer", "subsystem", "phase", "event_type", "severity", "confidence",
                          "source_file_id", "source_line", "source_offset") if c in events.columns]
    s = Series(events, [key], order).with_row_number("position").with_count("total")
    return s.frame.where(F.col("position") <= limit).select(key, "position", "total", *fields)


def incomplete_sessions(sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """Sessions to recompute: no features yet, or a stored span that differs from the one in the events."""
    df = sessions.join(spans, "session_id", "left")
    stale = F.col("span_start").isNotNull() & (~F.col("start_ts").eqNullSafe(F.col("span_start"))
                                               | ~F.col("end_ts").eqNullSafe(F.col("span_end")))
    reason = F.when(F.col("features").isNull(), "missing_features").when(stale, "stale_span")
    return df.withColumn("reason", reason).where("reason is not null")


def backfill(spark: SparkSession, sessions: DataFrame, spans: DataFrame, recompute, path: str, dry_run: bool = True) -> DataFrame:
    """Recomputes the incomplete sessions with ``recompute(ids) -> DataFrame``; writes unless ``dry_run``.

    Returns old and new span side by side.
    """
    todo = incomplete_sessions(sessions, spans).select("session_id", "reason", F.col("start_ts").alias("old_start"),
                                                       F.col("end_ts").alias("old_end"))
    fresh = recompute(todo.select("session_id"))
    diff = todo.join(fresh.select("session_id", F.col("start_ts").alias("new_start"), F.col("end_ts").alias("new_end")), "session_id", "left")
    if not dry_run:
        upsert(spark, path, fresh.withColumn("updated_at", F.current_timestamp()), ["session_id"], F.col("updated_at"))
    return diff
