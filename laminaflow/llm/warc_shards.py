"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key, so shards hold consecutive keys. A file is rolled when its compressed size reaches a
limit; every record is its own gzip member, so any record can be read alone. Headers are made anew from the row: digest,
length and a record id that depends on the key only, so equal input gives equal files. Of records with equal payloads
the one with the smallest key is a response, the others revisit it. Tasks write under temporary names; the manifest that
Spark commits says which files count, and only those get their final names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaflow.llm.tables import folder, map_batches, stored, texts_of
from laminaflow.llm.token_pack import as_uri, commit, put

FILE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value of RFC 4122 for URLs


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'record:{key}')}>"


def _header_text(value: str | None) -> str:
    """A header value has no line ends."""
    return " ".join((value or "").split())


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """One record with its headers, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http + payload if response else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_text(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Record-Key: {'' if key is None else key}",
    ]
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {'' if refers_to is None else refers_to}", "WARC-Truncated: length"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def first_with_payload(pages: DataFrame, key: str, payload: str, at_least: int) -> DataFrame:
    """Digest and smallest key of each payload of ``at_least`` bytes that occurs twice or more."""
    raw = F.coalesce(payload, F.lit("")).cast("binary")
    sized = pages.select(F.sha1(raw).alias("_digest"), F.col(key).alias("_key"), F.length(raw).alias("_n")).where(F.col("_n") >= at_least)
    return sized.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").select("_digest", "_first")


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0,
               base: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Writes a record for every row; returns the folder and its manifest (shard, seq, name, n_records, bytes).

    Null and empty payloads are empty ones and take part in the revisits if ``revisit_from`` is 0. Rows are ordered by
    (key, digest), null keys first; of equal payloads under one key the first row is the response. Records
    without a key are responses, whatever their payload. Payloads are written whole; a task holds one
    record and one compressed file.
    """
    spark = pages.sparkSession
    base = as_uri(base or folder(spark, "warc"))
    raw = F.coalesce(payload, F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.coalesce(payload, F.lit("")).alias("_payload"), F.sha1(raw).alias("_digest"))
    first = stored(first_with_payload(pages, key, payload, revisit_from), "warc-first")
    marked = rows.select("_key", "_digest").join(first, "_digest").where(F.col("_key").isNotNull()).groupBy("_key", "_digest").agg(F.min("_first").alias("_first"))
    marks = marked.select("_key", F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("_payload"), "_digest", "_first", F.lit(0).alias("_row"))
    both = rows.select("*", F.lit(None).cast(pages.schema[key].dataType).alias("_first"), F.lit(1).alias("_row")).unionByName(marks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        attempt, seq, held, records, shard = uuid.uuid4().hex, 0, io.BytesIO(), 0, 0
        mark, written = None, False

        def close() -> dict:
            name = f"part-{shard:06d}-{seq:05d}.warc.gz"
            put(base, f"_temporary/{attempt}/{name}", held.getvalue())
            return {"shard": [shard], "seq": [seq], "name": [name], "temporary": [f"_temporary/{attempt}/{name}"], "n_records": [records], "bytes": [held.tell()]}

        for batch in batches:
            shard = batch.column("_shard")[0].as_py() if batch.num_rows else shard
            columns = [batch.column(c).to_pylist() for c in ("_key", "_url", "_digest", "_first", "_row")]
            for k, (key_, url_, digest, first_, is_row) in enumerate(zip(*columns)):
                if not is_row:
                    mark, written = (key_, digest, first_), False
                    continue
                body = batch.column("_payload")[k].as_py().encode()
                own = mark if mark and mark[:2] == (key_, digest) else None
                response = own is None or own[2] == key_ and not written
                written = True
                held.write(_member(record_bytes(key_, url_, body, base64.b32encode(bytes.fromhex(digest)).decode(), response, None if response else own[2])))
                records += 1
                if held.tell() >= file_bytes:
                    yield close()
                    seq, held, records = seq + 1, io.BytesIO(), 0
        if records:
            yield close()

    rows = both.repartitionByRange("_key").sortWithinPartitions("_key", "_digest", "_row", "_url").withColumn("_shard", F.spark_partition_id())
    manifest = stored(map_batches(rows, kernel, "shard int, seq int, name string, temporary string, n_records long, bytes long"), "warc-manifest")
    commit(spark, manifest, base)
    return base, manifest.drop("temporary")


def split_headers(raw: bytes) -> tuple[dict[str, str], int]:
    """Headers of the record that begins ``raw`` and the place after them."""
    end = raw.index(b"\r\n\r\n") + 4
    lines = raw[:end].decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines if line), end


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file of gzip members."""
    while raw:
        z = zlib.decompressobj(31)
        record = z.decompress(raw)
        raw = z.unused_data
        headers, at = split_headers(record)
        yield headers, record[at:at + int(headers["Content-Length"])]


def read_warc(spark: SparkSession, base: str, key: str = "page_id", payloads: bool = True) -> DataFrame:
    """Per record: key, url, record_type, payload_digest (bare), refers_to, digest_ok, payload (null for revisits)."""
    number = lambda text: int(text) if text else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in _members(content.as_buffer()):
                    response = head["WARC-Type"] == "response"
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    own = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    ok = head["WARC-Block-Digest"] == f"sha1:{digest_of(block)}" and (not response or own == digest_of(body))
                    rows.append((number(head["X-Record-Key"]), head["WARC-Target-URI"], head["WARC-Type"], own, number(head.get("X-Refers-To-Key")), ok, int(split_headers(block)[0]["Content-Length"]), body if payloads and response else None))
                    size += len(body)
                    if size > 4 << 20:
                        yield columns(rows)
                        rows, size = [], 0
                if rows:
                    yield columns(rows)

    names = [key, "url", "record_type", "payload_digest", "refers_to", "digest_ok", "payload_bytes", *["payload"] * payloads]
    columns = lambda rows: dict(zip(names, zip(*rows)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(base).select("content")
    return map_batches(files, kernel, f"`{key}` long, url string, record_type string, payload_digest string, refers_to long, digest_ok boolean, payload_bytes long" + ", payload binary" * payloads)


def _members(buffer: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Like ``records_of``, without copying the rest of the file for each member."""
    view, at = memoryview(buffer), 0
    while at < len(view):
        z, parts, step = zlib.decompressobj(31), [], 64 << 10
        while not z.eof:
            parts.append(z.decompress(view[at:at + step]))
            at += min(step, len(view) - at)
        at -= len(z.unused_data)
        record = b"".join(parts)
        headers, start = split_headers(record)
        yield headers, record[start:start + int(headers["Content-Length"])]
