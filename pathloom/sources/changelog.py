"""A folder of growing change logs as a streaming source: spark.readStream.format("changelog").option("path", ...).

A log is a file of JSON lines, appended to by whoever watches a tree. The
offset of a stream is the number of bytes of each log that it has handed out,
always the end of a line: a stream that is stopped and started again goes on
there, and neither loses nor repeats a change. A line that isn't ended yet waits.
Logs that shrank were begun anew and are read from their start; those that are
gone are forgotten.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, ts timestamp, kind string, path string, is_dir boolean, mtime long, size long"


class _Range(InputPartition):
    def __init__(self, log: str, start: int, end: int):
        self.log, self.start, self.end = log, start, end


def _event(line: bytes) -> tuple | None:
    """The row of a line; None for what isn't an object with a path. A field of another kind counts as null."""
    try:
        got = json.loads(line)
    except ValueError:
        return None
    if not isinstance(got, dict) or not isinstance(got.get("path"), str):
        return None
    whole = lambda k: got[k] if isinstance(got.get(k), int) and not isinstance(got[k], bool) else None
    try:
        ts = datetime.fromisoformat(got["ts"])
        ts = ts if ts.tzinfo else ts.replace(tzinfo=UTC)
    except (KeyError, TypeError, ValueError):
        ts = None
    return whole("seq"), ts, str(got.get("kind")), got["path"], got["is_dir"] if isinstance(got.get("is_dir"), bool) else None, whole("mtime"), whole("size")


def _ended(log: str, upto: int) -> int:
    """The end of the last whole line within the first `upto` bytes."""
    with open(log, "rb") as f:
        at = upto
        while at > 0:
            start = max(0, at - 65536)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def _begin(log: str, at: int) -> int:
    """The begin of the first line that begins at `at` or later."""
    if at == 0:
        return 0
    with open(log, "rb") as f:
        f.seek(at - 1)
        f.readline()
        return f.tell()


class _Logs:
    """options: path; suffix (".jsonl"); split_bytes: about how much one task reads."""

    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.split = max(1, int(options.get("split_bytes", str(32 << 20))))

    def ends(self) -> dict[str, int]:
        out = {}
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name) if os.path.isdir(self.folder) else ():
            if entry.is_file() and entry.name.endswith(self.suffix):
                out[entry.name] = _ended(entry.path, entry.stat().st_size)
        return out

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[_Range]:
        out = []
        for name, upto in end.items():
            begin = start.get(name, 0)
            begin = 0 if begin > upto else begin
            out += [_Range(os.path.join(self.folder, name), at, min(at + self.split, upto)) for at in range(begin, upto, self.split)]
        return out

    @staticmethod
    def read(part: _Range) -> Iterator[tuple]:
        """The lines that begin in the range."""
        if not os.path.exists(part.log):
            return
        with open(part.log, "rb") as f:
            f.seek(_begin(part.log, part.start))
            while f.tell() < part.end:
                if (row := _event(f.readline())) is not None:
                    yield row


class ChangeLogStream(DataSourceStreamReader):
    def __init__(self, logs: _Logs):
        self.logs = logs

    def initialOffset(self) -> dict:
        return {"logs": "{}"}

    def latestOffset(self) -> dict:
        return {"logs": json.dumps(self.logs.ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.logs.ranges(json.loads(start["logs"]), json.loads(end["logs"]))

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.logs.read(partition)


class ChangeLogBatch(DataSourceReader):
    """All whole lines that are there now."""

    def __init__(self, logs: _Logs):
        self.logs = logs

    def partitions(self) -> list[_Range]:
        return self.logs.ranges({}, self.logs.ends()) or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.logs.read(partition)


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChangeLogBatch:
        return ChangeLogBatch(_Logs(self.options))

    def streamReader(self, schema) -> ChangeLogStream:
        return ChangeLogStream(_Logs(self.options))


def read_log(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ChangeLog)
    return spark.read.format("changelog").options(**options).load(folder)


def stream_log(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format("changelog").options(**options).load(folder)
