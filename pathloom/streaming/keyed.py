"""The change feed with keyed state: of each path the last change is remembered, so an older one that comes later is passed over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import paths
from ..operators import catalog as ops
from . import feed
from .parts import PartTable

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, seq long, us long, kind string, is_dir boolean, mtime long, size long"  # us: the time in microseconds
_FIELDS = ("seq", "us", "kind", "is_dir", "mtime", "size")
FOLDER_GONE = "folder gone"


class LastChange(StatefulProcessor):
    """Hands out a path's change if it is later, by (ts, seq), than all before it.

    keep_ms: how long a path's last change is remembered. grace_ms: when a folder was removed that
    long ago and hasn't come back, it is handed out again as `folder gone`, so
    that what was below it can go; 0: never.
    """

    def __init__(self, keep_ms: int, grace_ms: int):
        self.keep_ms, self.grace_ms = keep_ms, grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", CHANGES, self.keep_ms or None)

    @staticmethod
    def _row(values: tuple) -> Row:
        return Row(**dict(zip(("path", *_FIELDS), values)))

    @staticmethod
    def _order(row) -> tuple:
        return tuple(-(1 << 63) if x is None else x for x in (row.us, row.seq))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=self._order)
        known = self.last.get()  # None where there is none
        if known is not None and self._order(Row(us=known[2], seq=known[1])) >= self._order(best):
            return
        if self.grace_ms:  # else there are none, and each question is a call from Python
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        change = (key[0], *(best[f] for f in _FIELDS))
        self.last.update(change)
        if self.grace_ms and best.kind == "remove" and best.is_dir:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
        yield self._row(change)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if self.grace_ms and known is not None and known[3] == "remove" and known[4]:
            yield self._row((known[0], known[1], known[2], FOLDER_GONE, True, None, None))

    def close(self) -> None:
        pass


def newest_changes(events: DataFrame, keep_ms: int = 7 * 86_400_000, grace_ms: int = 0) -> DataFrame:
    """A stream of events (feed.EVENTS) as the stream of those that are newer than all before them of the same path.

    Events of excluded folders, of other kinds and without a path don't count; null times and numbers are
    the oldest. State: one row a path that changed within keep_ms.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = events.filter(F.col("kind").isin("create", "modify", "remove") & F.col("path").isNotNull())
    known = known.filter(~ops.built_in_excluded(F.col("path"), F.coalesce("is_dir", F.lit(False))))
    known = known.withColumn("us", F.unix_micros("ts"))
    out = known.groupBy("path").transformWithState(LastChange(keep_ms, grace_ms), CHANGES, "Update", "ProcessingTime")
    return out.select("seq", F.timestamp_micros("us").alias("ts"), "kind", "path", "is_dir", "mtime", "size")


def without_gone_folders(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """Catalog without what lies below the folders (path): an equi-join on ancestors."""
    above = catalog.select("path", F.explode(paths.ancestors(F.col("path"))).alias("__folder"))
    below = above.join(folders.select(F.col("path").alias("__folder")), "__folder", "left_semi").select("path").distinct()
    return ops.delete(catalog, below)


def follow(events: DataFrame, table: PartTable, checkpoint: str, keep_ms: int = 7 * 86_400_000, grace_ms: int = 0, **trigger) -> StreamingQuery:
    """Keep a table current with a stream of events, in whatever order they come; a batch rewrites only the parts it touches.

    A batch that is run again after a failure finds its changes made and makes them again.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if batch.limit(1).count():
            table.update(batch, lambda rows: feed.apply_events(rows, batch))
            gone = batch.filter(F.col("kind") == FOLDER_GONE).select("path")
            if gone.limit(1).count():
                table.write(without_gone_folders(table.read(), gone))
        batch.unpersist()

    out = newest_changes(events, keep_ms, grace_ms).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
