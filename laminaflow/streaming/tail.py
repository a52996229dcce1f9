"""A stream of the lines that growing files gain, as a data source: ``spark.readStream.format("tail")``.

The offset of the stream says for every file which version of it has been read up to which byte. A micro-batch reads the
bytes between two offsets and no others, in ranges that are spread over tasks. A last line without its end waits for the
next batch. A file that became shorter is a new version and is read from its start.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# the processes that plan and read a data source get it with its code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 16 << 20
LOOK_BACK = 1 << 16


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that begin in [start, stop); ``end`` is a line end behind them."""

    path: str
    version: int
    start: int
    stop: int
    end: int
    mtime: float
    first: bool


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.base = options["path"]
        self.suffixes = tuple(filter(None, options.get("suffix", "").split(",")))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.known: dict[str, list] = {}

    def _files(self):
        fs, root = pafs.FileSystem.from_uri(self.base if "://" in self.base else f"file://{self.base}")
        return fs, [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file and i.path.endswith(self.suffixes or ("",))
                    and not i.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, found = self._files()
        now = {}
        for info in found:
            version, upto, _ = self.known.get(info.path, [0, 0, 0.0])
            if info.size < upto:
                version, upto = version + 1, 0
            now[info.path] = [version, last_line_end(fs, info.path, upto, info.size), info.mtime_ns / 1e9]
        # a file that is gone keeps its place, so that it is not read again if it comes back
        self.known = {**self.known, **now}
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (version, upto, mtime) in sorted(after.items()):
            old, begin, _ = before.get(path, [version, 0, 0.0])
            if old != version or begin > upto:  # shortened, seen now or across a restart
                begin = 0
            for at in range(begin, upto, self.range_bytes):
                out.append(ByteRange(path, version, at, min(at + self.range_bytes, upto), upto, mtime, at == begin))
        self.known = {**after, **self.known}
        return out

    def read(self, part: ByteRange) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.base if "://" in self.base else f"file://{self.base}")
        stamp = dt.datetime.fromtimestamp(part.mtime, dt.timezone.utc)
        with fs.open_input_file(part.path) as file:
            for offset, raw in lines_of_range(file, part.start, part.stop, part.end, part.first):
                yield part.path, stamp, part.version, offset, raw.decode("utf-8", "replace").rstrip("\r")

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the checkpoint of the stream."""


def last_line_end(fs, path: str, low: int, size: int) -> int:
    """The end of the last whole line between ``low`` and ``size``; reads backwards, so about one line."""
    with fs.open_input_file(path) as file:
        high = size
        while high > low:
            at = max(low, high - LOOK_BACK)
            file.seek(at)
            place = file.read(high - at).rfind(b"\n")
            if place >= 0:
                return at + place + 1
            high = at
    return low


def lines_of_range(file, start: int, stop: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, stop); ``first`` says that one begins at ``start``.

    Any other range looks at the byte before it, to know whether a line begins there.
    """
    at = start if first else start - 1
    file.seek(at)
    held, where, skipping = b"", at, not first
    while where < end:
        chunk = file.read(min(1 << 20, end - where))
        if not chunk:
            return
        where += len(chunk)
        *whole, held = (held + chunk).split(b"\n")
        for line in whole:
            if not skipping:
                if at >= stop:
                    return
                yield at, line
            skipping = False
            at += len(line) + 1
        if at >= stop and not skipping:
            return


class TailSource(DataSource):
    """Options: path (a folder), suffix (comma-separated), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "source string, mtime timestamp, version long, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def read_tail(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines that the files below ``path`` gain: source, mtime, place (version of the file, byte offset), line."""
    spark.dataSource.register(TailSource)
    raw = spark.readStream.format("tail").option("path", path).option("suffix", suffix).option("rangeBytes", str(range_bytes)).load()
    return raw.select("source", "mtime", F.struct("version", "offset").alias("place"), "line")
