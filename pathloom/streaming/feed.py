"""The change feed: file events and opens as streams that keep tables current."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..operators import catalog as ops
from .parts import PartTable

EVENTS = "seq long, ts timestamp, kind string, path string, is_dir boolean, mtime long, size long"
OPENS = "seq long, ts timestamp, file string"


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path, by ts and seq; kinds other than create, modify and remove don't count.

    An event below an excluded folder doesn't count. A create or modify whose
    file is gone (null size) counts as a remove.
    """
    known = events.filter(F.col("kind").isin("create", "modify", "remove"))
    known = known.filter(~ops.built_in_excluded(F.col("path"), F.coalesce("is_dir", F.lit(False))))
    last = ops.latest(known.select("path", "ts", "seq", "kind", "is_dir", "mtime", "size"))
    gone = (F.col("kind") == "remove") | F.col("size").isNull()
    return last.withColumn("kind", F.when(gone, "remove").otherwise("upsert"))


def apply_events(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """Catalog after a batch of events. A removed folder's children stay until a sweep."""
    last = last_events(events)
    kept = ops.delete(catalog, last.filter("kind = 'remove'"))
    return ops.upsert(kept, last.filter("kind = 'upsert'").select("path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "mtime", "size"))


def follow(events: DataFrame, table: PartTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of events batch by batch; a batch rewrites only the parts of the table that its paths fall in.

    A batch that is run again after a failure or a restart makes the same changes
    once more, which alters nothing. A batch counts as later than those before
    it; where events may come late, `keyed.follow` holds their order.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read once, for the parts and for their rows
        table.update(batch, lambda rows: apply_events(rows, batch))
        batch.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A change log of JSON files as a stream."""
    return spark.readStream.schema(EVENTS).options(**options).json(folder)


def open_counts(opens: DataFrame) -> DataFrame:
    """file, open_count, last_opened: as a batch or, in complete or update mode, as a stream."""
    return opens.groupBy("file").agg(F.count("*").alias("open_count"), F.max(F.unix_timestamp("ts")).alias("last_opened"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """An addition: events without repetitions (path, kind, ts, seq), with state bounded by a watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "kind", "ts", "seq"])


def event_rate(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition: events by window and kind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def sweep(catalog: DataFrame, scanned: DataFrame, number: int, sweeps: int, absent_roots: list[str] = ()) -> DataFrame:
    """Catalog without the vanished rows of one share; a sweep of all shares reaches every row once."""
    gone = ops.vanished(ops.sweep_share(catalog, number, sweeps), scanned, absent_roots)
    return ops.delete(catalog, gone)


def sweeps_for(n_files: int, share: int = 5000) -> int:
    """How many sweeps reach all files when each looks at about `share` of them."""
    return max(1, -(-n_files // share))


def every(spark: SparkSession, seconds: float, job: Callable[[int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Run a job (given the number of the turn) again and again, as a streaming query that can be stopped and watched."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out = clock.writeStream.foreachBatch(lambda _, number: job(number)).trigger(processingTime=f"{seconds} seconds")
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def integrity_job(table: PartTable, roots: list[str], look: Callable[[DataFrame], DataFrame] | None = None, there: Callable[[str], bool] = os.path.exists, share: int = 5000) -> Callable[[int], None]:
    """A job for `every` (60 seconds): one share of the table's rows a turn is looked up on disk; rows whose file is gone go.

    look: the rows of a table of paths that are there, by default a stat of each
    path in the tasks; nothing else of the tree is read. Rows below a root that
    can't be reached now are left alone.
    """
    from ..sources.tree import look_up

    def turn(number: int) -> None:
        catalog = table.read()
        reached = [r for r in roots if there(r)]
        if not reached:
            return
        absent = [r for r in roots if r not in reached]
        mine = ops.sweep_share(catalog.filter(paths.under_any(F.col("path"), roots)), number, sweeps_for(catalog.count(), share))
        mine = mine.filter(~paths.under_any(F.col("path"), absent)) if absent else mine
        gone = ops.vanished(mine, (look or look_up)(mine.select("path"))).select("path").persist()
        if gone.limit(1).count():
            table.update(gone, lambda rows: ops.delete(rows, gone))
        gone.unpersist()

    return turn


def network_job(table: PartTable, scan: Callable[[str], DataFrame], roots: list[str], there: Callable[[str], bool] = os.path.exists) -> Callable[[int], None]:
    """A job for `every` (300 seconds): scan network roots again, those that are absent left out, and write what they touch once. Nothing is deleted by it."""

    def turn(number: int) -> None:
        found = None
        for root in filter(there, roots):
            rows = scan(root).filter(paths.under(F.col("path"), root)).select(*ops.FIELDS)
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return
        found = found.dropDuplicates(["path"]).persist()  # roots may lie in one another
        table.update(found, lambda rows: ops.upsert(rows, found))
        found.unpersist()

    return turn


def changes(catalog: DataFrame, scanned: DataFrame, root: str, at: Column | None = None) -> DataFrame:
    """What happened below a root between a catalog and a scan, as events: create, modify (kind, time or size differ) and remove.

    at: when, by default now. The order of such events doesn't matter: each path has one.
    """
    own = lambda rows: rows.filter(paths.under(F.col("path"), root)).select("path", F.struct("is_dir", "mtime", "size").alias("is"))
    both = own(catalog).withColumnRenamed("is", "was").join(own(scanned), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "create").when(F.col("is").isNull(), "remove").when(F.col("was") != F.col("is"), "modify")
    out = both.withColumn("kind", kind).filter("kind is not null").withColumn("file", F.coalesce("is", "was"))
    return out.select(F.xxhash64("path").alias("seq"), (F.current_timestamp() if at is None else at).alias("ts"), "kind", "path", "file.is_dir", F.col("is.mtime").alias("mtime"), F.col("is.size").alias("size"))


def watch_job(table: PartTable, scan: Callable[[str], DataFrame], roots: list[str], there: Callable[[str], bool] = os.path.exists) -> Callable[[int], None]:
    """A job for `every`: local roots watched by scanning them, as a change feed that is applied at once. Absent roots are left alone."""

    def turn(number: int) -> None:
        for root in filter(there, roots):
            seen = changes(table.read(), scan(root), root).persist()
            if seen.limit(1).count():
                table.update(seen, lambda rows, seen=seen: apply_events(rows, seen))
            seen.unpersist()

    return turn


def led_job(table: PartTable, roots: list[str], there: Callable[[str], bool] = os.path.exists) -> Callable[[int], None]:
    """As watch_job, led by the table: only folders whose time differs from the table's are listed again (sources.tree.changed_below)."""
    from ..sources.tree import changed_below

    def turn(number: int) -> None:
        for root in filter(there, roots):
            seen = changed_below(table.read(), root)
            if seen.limit(1).count():
                table.update(seen, lambda rows, seen=seen: apply_events(rows, seen))
            seen.unpersist()

    return turn


def rescan(catalog: DataFrame, scanned: DataFrame, root: str) -> DataFrame:
    """Catalog with a root's scan put in. Nothing is deleted by it."""
    return ops.upsert(catalog, scanned.filter(paths.under(F.col("path"), root)).select(*ops.FIELDS))
