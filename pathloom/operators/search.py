"""Searching a catalog: scope, filter, sort, cut."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frecency, paths
from ..plans import compile as plan
from ..plans.language import FOLDERS, FUZZY, Query, Sort, parse, refines
from .intervals import holder

MOST_RESULTS = 2000  # fixed values: the hard cap and the default
DEFAULT_RESULTS = 500

Roots = list[tuple[str, str]]  # (name, path), in order
LITERAL_ROOTS = 64


def sort_keys(sort: Sort) -> list[Column]:
    """Ties always go by path, so that a cut is the same every time."""
    path = F.col("path")
    first = {
        Sort.NEWEST: [F.desc("mtime")],
        Sort.OLDEST: [F.asc("mtime")],
        Sort.NAME: [paths.name(path).asc()],
        Sort.NAME_DOWN: [paths.name(path).desc()],
        Sort.LARGEST: [F.desc("size")],
        Sort.SMALLEST: [F.asc("size")],
        Sort.PATH: [],
        Sort.FRECENCY: [F.desc("score")],
    }[sort]
    return [*first, path.asc()]


def cut(rows: DataFrame, sort: Sort, most: int = DEFAULT_RESULTS, access: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """The first rows in order, each with its rank. access: (file, open_count, last_opened), for frecency."""
    columns = rows.columns
    if sort == Sort.FRECENCY:
        now = int(time.time()) if now is None else now
        if access is None:
            rows = rows.withColumn("score", F.lit(0.0))
        elif (led := _led_by_use(rows, access, now, max(1, min(most, MOST_RESULTS)))) is not None:
            if "rank" in led.columns:
                return led.select("rank", *columns)
            rows = led
        else:
            known = access.select(F.col("file").alias("__file"), frecency.score(F.col("open_count"), F.col("last_opened"), now).alias("score"))
            rows = rows.join(known, F.col("path") == F.col("__file"), "left").drop("__file").withColumn("score", F.coalesce("score", F.lit(0.0)))
    top = rows.orderBy(*sort_keys(sort)).limit(max(1, min(most, MOST_RESULTS)))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*sort_keys(sort))))  # over the few rows that are left
    return ranked.select("rank", *columns)


USED = 4  # times as many of the most used files as rows are asked for are looked for by name


def _led_by_use(rows: DataFrame, access: DataFrame, now: int, most: int) -> DataFrame | None:
    """Rows with their `score` that hold the first `most` by use, or just these with their `rank`: from the side of the uses, without a join of all rows.

    The most used files, in the order of the result, are looked for by name. If
    they give enough rows, these are the result; if no more files were ever
    used, all others have no score and the first of them by path fill up. Else
    None: the rows have to be joined.
    """
    score = frecency.score(F.col("open_count"), F.col("last_opened"), now)
    spark, n = rows.sparkSession, USED * most
    used = access.select(F.col("file").alias("__file"), score.alias("score")).filter("score > 0 and __file is not null")
    best = used.orderBy(F.desc("score"), "__file").limit(n).toArrow()  # n names at most
    if not best.num_rows:
        return rows.orderBy("path").limit(most).withColumn("score", F.lit(0.0))
    known = F.broadcast(spark.createDataFrame(best))
    hits = rows.join(known, F.col("path") == F.col("__file")).drop("__file")
    if best.num_rows < n:
        others = rows.join(known, F.col("path") == F.col("__file"), "left_anti").orderBy("path").limit(most)
        return hits.unionByName(others.withColumn("score", F.lit(0.0)))
    found = hits.orderBy(F.desc("score"), "path").limit(most).toArrow()  # MOST_RESULTS rows at most
    if found.num_rows < most:
        return None
    ranks = pa.array(range(1, most + 1), pa.int32())
    return spark.createDataFrame(found.append_column("rank", ranks))


def attribute(rows: DataFrame, roots: Roots, outside: bool = False) -> DataFrame:
    """Rows with the name of the first root that holds them, as `bookmark`.

    Others are dropped, or keep an empty name (outside). Few roots become one
    expression; many become a sweep over the sorted paths (intervals.py).
    """
    if len(roots) <= LITERAL_ROOTS:
        out = rows.withColumn("bookmark", paths.first_root(F.col("path"), roots))
    else:
        listed = rows.sparkSession.createDataFrame([(i, n, p) for i, (n, p) in enumerate(roots)], "ord int, value string, path string")
        out = holder(rows, listed, "bookmark")
    return out.withColumn("bookmark", F.coalesce("bookmark", F.lit(""))) if outside else out.filter("bookmark is not null")


def search_root(catalog: DataFrame, query: Query | str, root: str = "", most: int = DEFAULT_RESULTS, **order) -> DataFrame:
    """rank, path, is_dir, mtime, size of one root; an empty root doesn't restrict."""
    query = parse(query) if isinstance(query, str) else query
    scope = paths.under(F.col("path"), root) if root else F.lit(True)
    rows = catalog.filter(scope & plan.row_filter(query)).select("path", "is_dir", "mtime", "size")
    return cut(rows, query.sort, most, **order)


def search_all(catalog: DataFrame, query: Query | str, roots: Roots, most: int = DEFAULT_RESULTS, **order) -> DataFrame:
    """rank, path, is_dir, mtime, size, bookmark over all roots."""
    query = parse(query) if isinstance(query, str) else query
    rows = attribute(catalog.filter(plan.row_filter(query)), roots)
    return cut(rows.select("path", "is_dir", "mtime", "size", "bookmark"), query.sort, most, **order)


def search_tagged(entries: DataFrame, catalog: DataFrame, query: Query | str, roots: Roots, most: int = DEFAULT_RESULTS, **order) -> DataFrame:
    """Search over tag entries (root, rel, tags): few rows first, the catalog joined for time and size.

    Entries outside all roots stay, with an empty name; entries that the
    catalog doesn't have are dropped; a file in two tag stores comes twice.
    """
    query = parse(query) if isinstance(query, str) else query
    rows = entries.filter(plan.tag_filter(query.tags, F.col("tags")) & F.lit(query.kind != FOLDERS))
    rows = rows.select(F.concat("root", F.lit("/"), "rel").alias("path"))
    rows = rows.filter(plan.extension_filter(query.extension) & plan.text_filter(query, tagged=query.mode == FUZZY))
    rows = rows.join(catalog.select("path", "mtime", "size"), "path").withColumn("is_dir", F.lit(False))
    rows = attribute(rows, roots, outside=True)
    return cut(rows.select("path", "is_dir", "mtime", "size", "bookmark"), query.sort, most, **order)


def request_search(catalog: DataFrame, text: str, root: str = "", extension: str | None = None, kind: str = "all", most: int = DEFAULT_RESULTS) -> DataFrame:
    """Single-root request: the request's extension and kind replace those of the text, tags are ignored, newest first."""
    query = replace(parse(text), extension=extension, kind=kind, tags=(), sort=Sort.NEWEST)
    return search_root(catalog, query, root, most)


def request_search_all(catalog: DataFrame, text: str, roots: Roots, requested: list[str] | None = None, extension: str | None = None, most: int = DEFAULT_RESULTS) -> DataFrame:
    """Request over all roots, or over `requested` paths; a row whose first requested path isn't a root is dropped."""
    query = replace(parse(text), extension=extension, tags=(), sort=Sort.NEWEST)
    if not requested:
        return search_all(catalog, query, roots, most)
    named = {p: n for n, p in reversed(roots)}
    missing = "\0"
    rows = attribute(catalog.filter(plan.row_filter(query)), [(named.get(p, missing), p) for p in requested]).filter(F.col("bookmark") != missing)
    return cut(rows.select("path", "is_dir", "mtime", "size", "bookmark"), query.sort, most)


def answer(rows: DataFrame, total_indexed: int, search_ms: int) -> DataFrame:
    """One JSON text of a request's result, rows in order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", *[c for c in rows.columns if c != "rank"])))
    body = rows.agg(listed.alias("results"))
    body = body.withColumn("results", F.transform("results", lambda r: r.dropFields("rank")))
    return body.select(F.to_json(F.struct("results", F.lit(total_indexed).alias("total_indexed"), F.lit(search_ms).alias("search_time_ms"))).alias("json"))


@dataclass
class RefinementCache:
    """The last result, kept to answer a query whose rows are among it."""

    lifetime: float = 5.0
    query: Query | None = None
    rows: DataFrame | None = None
    whole: bool = False
    at: float = field(default=0.0)

    def valid_for(self, new: Query, clock: float) -> bool:
        return self.query is not None and self.whole and clock - self.at <= self.lifetime and refines(self.query, new)

    def keep(self, query: Query, rows: DataFrame, n: int, most: int, clock: float) -> None:
        self.clear()
        self.query, self.rows, self.whole, self.at = query, rows, n < most, clock

    def clear(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()
        self.query = self.rows = None


class Engine:
    """A catalog with its roots: the public face of the searches.

    table: a PartTable that holds the catalog; changes are written to the parts
    they touch, and later searches read what was written. settings: a file that the roots
    are saved to. scan: how a root is scanned, (root) -> rows; by default the
    file tree source.
    """

    def __init__(self, catalog: DataFrame, roots: Roots, exclude_paths: list[str] = (), most: int = DEFAULT_RESULTS, entries: DataFrame | None = None, access: DataFrame | None = None, cache: bool = False, table=None, settings: str | None = None, scan=None):
        self.exclude_paths = list(exclude_paths)
        self.catalog = catalog.filter(~paths.under_any(F.col("path"), self.exclude_paths)) if exclude_paths else catalog
        self.roots, self.most, self.entries, self.access = list(roots), max(1, min(most, MOST_RESULTS)), entries, access
        self.network: set[str] = set()
        self.cache = RefinementCache() if cache else None
        self.table, self.settings, self._scan = table, settings, scan
        self.counted: tuple | None = None  # the catalog and its statistics, once they were asked for
        self._lock = threading.RLock()  # of changes: a server's threads share the engine

    def search(self, raw: str, sort: int = 0, now: int | None = None) -> DataFrame:
        query = parse(raw, sort)
        order = {"access": self.access, "now": now}
        if query.tags:
            if self.entries is None:
                raise ValueError("tag search needs tag entries")
            return search_tagged(self.entries, self.catalog, query, self.roots, self.most, **order)
        if self.cache is None:
            return search_all(self.catalog, query, self.roots, self.most, **order)
        clock = time.monotonic()
        if self.cache.valid_for(query, clock):
            kept = self.cache.rows.filter(plan.row_filter(query)).drop("rank")
            rows = cut(kept, query.sort, self.most, **order).cache()
        else:
            rows = search_all(self.catalog, query, self.roots, self.most, **order).cache()
        self.cache.keep(query, rows, rows.count(), self.most, clock)
        return rows

    def test_search(self, raw: str, shown: int = 3) -> int:
        """How many rows a search finds; prints the first few."""
        rows = self.search(raw).orderBy("rank").collect()  # at most `most`
        for row in rows[:shown]:
            print(row.path)
        print(f"{len(rows)} found for {raw!r}")
        return len(rows)

    def file_count(self) -> int:
        return self.catalog.count()

    def bookmarks(self) -> Roots:
        return list(self.roots)

    def _changed(self, paths_of: DataFrame, change) -> None:
        """Apply a change of rows: to the parts of the table that the paths fall in, or to the catalog itself."""
        with self._lock:
            if self.table is not None:
                self.table.update(paths_of, change)
                self.catalog = self.table.read()
            else:
                self.catalog = change(self.catalog)
            self.clear_search_cache()

    def _save_roots(self) -> None:
        if self.settings is not None:
            from ..sources.config import Settings

            kept = Settings.load(self.settings)
            kept.bookmarks = [{"name": n, "path": p, "is_network": p in self.network} for n, p in self.roots]
            kept.save(self.settings)

    def scan(self, root: str) -> DataFrame:
        if self._scan is not None:
            return self._scan(root)
        from ..sources.tree import scan

        return scan(self.catalog.sparkSession, root, exclude_paths=self.exclude_paths)

    def rescan_path(self, root: str) -> int:
        """Put what a scan of the path finds into the catalog (nothing is deleted); how many rows it found."""
        from .catalog import FIELDS, upsert

        found = self.scan(root).select(*FIELDS).persist()
        n = found.count()
        self._changed(found, lambda rows: upsert(rows, found))
        if self.table is not None:  # else the catalog still reads it
            found.unpersist()
        return n

    def rescan_all(self) -> int:
        return sum(self.rescan_path(root) for _, root in self.roots)

    def add_bookmark(self, name: str, path: str, rows: DataFrame | None = None, is_network: bool = False) -> None:
        """A root with its rows, scanned unless given; an old one of that path is replaced."""
        from .catalog import upsert

        with self._lock:
            self.roots = [r for r in self.roots if r[1] != path] + [(name, path)]
            self.network = self.network | {path} if is_network else self.network - {path}
            self._save_roots()
        if rows is None:
            self.rescan_path(path)
        else:
            self._changed(rows, lambda held: upsert(held, rows))

    def _root_of(self, which: str) -> str:
        """The path of a root given by name, or by path."""
        return next((p for n, p in self.roots if n == which), which)

    def remove_bookmark(self, which: str) -> None:
        path = self._root_of(which)
        with self._lock:
            self.roots = [r for r in self.roots if r[1] != path]
            self._save_roots()
        own = paths.under(F.col("path"), path)
        self._changed(self.catalog.filter(own), lambda rows: rows.filter(~own))

    def rename_bookmark(self, which: str, name: str) -> None:
        path = self._root_of(which)
        with self._lock:
            self.roots = [(name, p) if p == path else (n, p) for n, p in self.roots]
            self._save_roots()
            self.clear_search_cache()

    def record_file_open(self, path: str, now: int | None = None) -> bool:
        """Count an open of a file that the catalog has, for the order by use; whether it has it."""
        spark = self.catalog.sparkSession
        if not self.catalog.filter(F.col("path") == path).limit(1).count():
            return False
        once = spark.createDataFrame([(path, 1, int(time.time()) if now is None else now)], "file string, open_count long, last_opened long")
        both = once if self.access is None else self.access.select(*once.columns).unionByName(once)
        self.access = both.groupBy("file").agg(F.sum("open_count").alias("open_count"), F.max("last_opened").alias("last_opened"))
        return True

    def clear_search_cache(self) -> None:
        if self.cache is not None:
            self.cache.clear()
