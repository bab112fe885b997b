"""File trees as a Spark data source: spark.read.format("filetree").option("path", ...).

Hidden files are listed too, which Spark's own file sources leave out. Planning
opens folders, the root first, level by level until there are enough of them:
each opened folder's own files are a partition, and so is the whole tree below
each folder that wasn't opened. So a tree with one large folder is split below
it. Excluded folders are not descended into; what can't be read is left out.
"""

from __future__ import annotations

import os
import stat
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths
from ..operators.catalog import EXCLUDED_NAMES

SCHEMA = "path string, is_dir boolean, mtime long, size long, mtime_ns long, mode int, nlink long, uid int, gid int"


def _row(path: str) -> tuple | None:
    """Links aren't followed for the kind; time and size are those of the target."""
    try:
        own = os.lstat(path)
    except OSError:
        return None
    try:
        target = os.stat(path)
    except OSError:
        target = None
    is_dir = stat.S_ISDIR(own.st_mode)
    ns = max(target.st_mtime_ns, 0) if target else 0
    size = 0 if is_dir or target is None else target.st_size
    return path, is_dir, ns // 10**9, size, ns, own.st_mode, own.st_nlink, own.st_uid, own.st_gid


def _is_under(path: str, root: str) -> bool:
    bare = root.rstrip("/")
    return bool(root) and (path == bare or path.startswith(bare + "/"))


def _skipped(path: str, name: str, is_dir: bool, user: tuple[str, ...]) -> bool:
    if is_dir and (name in EXCLUDED_NAMES or name.startswith(".Trash")):
        return True
    return any(_is_under(path, u) for u in user)


class _Part(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, exclude: bool, user: tuple[str, ...], most: int, begins: str = ""):
        self.root, self.exclude, self.user, self.most = root.rstrip("/") or "/", exclude, user, most
        self.begins = begins

    def _wanted(self, path: str) -> bool:
        return path.startswith(self.begins)

    def _leads_on(self, folder: str) -> bool:
        """Whether something below a folder may be wanted."""
        below = folder.rstrip("/") + "/"
        return self.begins.startswith(below) or below.startswith(self.begins)

    def _children(self, folder: str):
        if not self._leads_on(folder):
            return
        try:
            with os.scandir(folder) as found:
                listed = sorted(found, key=lambda e: e.name)
        except OSError:
            return
        for entry in listed:
            try:
                is_dir = entry.is_dir(follow_symlinks=False)
            except OSError:
                continue
            path = os.path.join(folder, entry.name)
            if not (self.exclude and _skipped(path, entry.name, is_dir, self.user)):
                yield path, is_dir

    def partitions(self):
        opened, waiting = [], deque([self.root])
        while waiting and len(waiting) + len(opened) < self.most:
            folder = waiting.popleft()
            opened.append(folder)
            waiting += [p for p, is_dir in self._children(folder) if is_dir and (self._leads_on(p) or self._wanted(p))]
        return [*(_Part(p, False) for p in opened), *(_Part(p, True) for p in waiting)]

    def read(self, partition):
        if self._wanted(partition.path) and (row := _row(partition.path)) is not None:
            yield row
        stack = [partition.path]
        while stack:
            for path, is_dir in self._children(stack.pop()):
                if is_dir and not partition.deep:
                    continue  # a partition of its own
                if self._wanted(path) and (row := _row(path)) is not None:
                    yield row
                if is_dir:
                    stack.append(path)


class TreeSource(DataSource):
    """Options: path; exclude ("true": built-in names and `exclude_paths`); exclude_paths, parted by line feeds; begins: what paths begin with, so that other subtrees aren't opened; partitions: about how many."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        user = tuple(p for p in self.options.get("exclude_paths", "").split("\n") if p)
        return TreeReader(self.options["path"], self.options.get("exclude", "true").lower() == "true", user, int(self.options.get("partitions", "64")), self.options.get("begins", ""))


def scan(spark: SparkSession, root: str, exclude: bool = True, exclude_paths: list[str] = (), begins: str = "") -> DataFrame:
    """The root itself and everything below it, as far as its path begins so."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("filetree").option("exclude", str(exclude).lower()).option("exclude_paths", "\n".join(exclude_paths)).option("begins", begins)
    return reader.load(root)


def tag_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel, path, size, mtime_ns) of the regular files of a tag tree, without the tag store's own."""
    files = scan(spark, root, exclude=False).filter(F.col("mode").bitwiseAND(0o170000) == 0o100000)
    return files.withColumn("rel", paths.relative(F.col("path"), root)).filter("rel is not null").select("rel", "path", "size", "mtime_ns")


_FOUND = "path string, is_dir boolean, mtime long, size long"


def look_up(rows: DataFrame) -> DataFrame:
    """path, is_dir, mtime, size of those paths of a table that are there: each is looked at by itself, and no folder is listed."""
    import pyarrow as pa

    def stat_all(batches):
        for batch in batches:
            found = [r[:4] for p in batch.column("path").to_pylist() if p is not None and (r := _row(p)) is not None]
            columns = zip(*found) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["path", "is_dir", "mtime", "size"])

    return rows.select("path").mapInArrow(stat_all, _FOUND)


def listed_again(folders: DataFrame, exclude: bool = True, exclude_paths: tuple[str, ...] = ()) -> DataFrame:
    """state, path, is_dir, mtime, size for a table of known folders (path, mtime).

    gone: a folder that isn't there (any more as one); changed: one whose time
    differs, as it is now; child: what such a folder holds. Folders with the
    same time give nothing, and aren't listed.
    """
    import pyarrow as pa

    def visit(batches):
        lister = TreeReader("/", exclude, tuple(exclude_paths), 1)
        for batch in batches:
            out = []
            for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist()):
                own = _row(path)
                if own is None or not own[1]:
                    out.append(("gone", path, True, None, None))
                elif own[2] != mtime:
                    out.append(("changed", *own[:4]))
                    out += [("child", *row[:4]) for p, _ in lister._children(path) if (row := _row(p)) is not None]
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), kinds)], names=["state", "path", "is_dir", "mtime", "size"])

    return folders.select("path", "mtime").mapInArrow(visit, f"state string, {_FOUND}")


def walked(folders: DataFrame, exclude: bool = True, exclude_paths: tuple[str, ...] = ()) -> DataFrame:
    """path, is_dir, mtime, size of everything below the folders of a table (path), the folders not included."""
    import pyarrow as pa

    def walk(batches):
        reader = TreeReader("/", exclude, tuple(exclude_paths), 1)
        for batch in batches:
            for top in batch.column("path").to_pylist():
                rows = [r[:4] for r in reader.read(_Part(top, True)) if r[0] != top]
                columns = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["path", "is_dir", "mtime", "size"])

    return folders.select("path").mapInArrow(walk, _FOUND)


def changed_below(catalog: DataFrame, root: str, files: bool = False, exclude: bool = True, exclude_paths: tuple[str, ...] = ()) -> DataFrame:
    """What happened below a root since the catalog was made, as events (feed.EVENTS), without reading the tree whole.

    Each folder that the catalog has is looked at; only those whose time differs
    are listed, and only folders that the catalog hasn't are walked. A file
    that was written to in place alters no folder's time: with `files` each
    known file below the root is looked at too. The events are found at once and
    persisted: unpersist() them in the end.
    """
    import uuid

    known = catalog.filter(paths.under(F.col("path"), root)).select("path", F.struct("is_dir", "mtime", "size").alias("was"))
    if not known.limit(1).count():
        top = catalog.sparkSession.createDataFrame([(root.rstrip("/") or "/",)], "path string")
        rows = look_up(top).unionByName(walked(top, exclude, exclude_paths))
        return rows.select(F.xxhash64("path").alias("seq"), F.current_timestamp().alias("ts"), F.lit("create").alias("kind"), "path", "is_dir", "mtime", "size").persist()
    # Looked at once, now: what an earlier call has persisted mustn't stand in for it.
    folders = known.filter(F.col("was.is_dir") & (F.lit(uuid.uuid4().hex) != F.col("path"))).select("path", "was.mtime")
    seen = listed_again(folders, exclude, exclude_paths).persist()
    now = F.struct("is_dir", "mtime", "size").alias("is")
    touched = seen.filter("state <> 'child'").select(F.col("path").alias("folder"))
    new = seen.filter("state = 'child' and is_dir").join(known, "path", "left_anti")
    found = seen.filter("state <> 'gone'").select("path", now).unionByName(walked(new, exclude, exclude_paths).select("path", now)).dropDuplicates(["path"])
    # What the catalog has in a folder that was listed or is gone, and these folders themselves.
    beside = known.withColumn("folder", paths.parent(F.col("path"))).join(touched, "folder", "left_semi").drop("folder")
    own = known.join(touched.withColumnRenamed("folder", "path"), "path", "left_semi")
    both = beside.unionByName(own).dropDuplicates(["path"]).join(found, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "create").when(F.col("is").isNull(), "remove").when(F.col("was") != F.col("is"), "modify")
    out = both.withColumn("kind", kind).filter("kind is not null")
    if files:
        rest = known.filter("not was.is_dir").join(both.select("path"), "path", "left_anti")
        there = look_up(rest.select("path")).select("path", now)
        more = rest.join(there, "path", "left").withColumn("kind", F.when(F.col("is").isNull(), "remove").when(F.col("was") != F.col("is"), "modify")).filter("kind is not null")
        out = out.unionByName(more)
    out = out.withColumn("file", F.coalesce("is", "was"))
    out = out.select(F.xxhash64("path").alias("seq"), F.current_timestamp().alias("ts"), "kind", "path", "file.is_dir", F.col("is.mtime").alias("mtime"), F.col("is.size").alias("size")).persist()
    out.count()
    seen.unpersist()
    return out
