"""Keeping a catalog (path, is_dir, mtime, size and perhaps id) current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

# Folder names that are never indexed.
EXCLUDED_NAMES = (".git", "node_modules", "__pycache__", ".cache", ".npm", ".cargo", "target", "build", "dist", ".next", ".nuxt", ".Trash", "Trash", ".steam", "dosdevices")
# Network file systems.
NETWORK_TYPES = ("nfs", "nfs4", "cifs", "smb", "smbfs", "fuse.sshfs")

FIELDS = ("path", "is_dir", "mtime", "size")


def built_in_excluded(path: Column, is_dir: Column) -> Column:
    """A folder with an excluded name (or one that begins with .Trash), or anything below one. A file of such a name stays."""
    names = "|".join(n.replace(".", r"\.") for n in EXCLUDED_NAMES)
    below = path.rlike(rf"/(?:{names}|\.Trash[^/]*)/")
    own = paths.name(path)
    return (is_dir & (own.isin(*EXCLUDED_NAMES) | F.startswith(own, F.lit(".Trash")))) | below


def without_excluded(catalog: DataFrame, user_paths: list[str] = ()) -> DataFrame:
    gone = built_in_excluded(F.col("path"), F.col("is_dir"))
    return catalog.filter(~gone & ~paths.under_any(F.col("path"), list(user_paths)))


def without_user_excluded(catalog: DataFrame, user_paths: list[str]) -> DataFrame:
    return catalog.filter(~paths.under_any(F.col("path"), user_paths))


def latest(changes: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last change of each key, combined before the shuffle."""
    rest = [c for c in changes.columns if c != key and c not in order]
    last = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__last")
    return changes.groupBy(key).agg(last).select(key, "__last.*")


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Catalog with `rows` (one a path) put in: known paths take the new kind, time and size, and keep other columns (id)."""
    kept = [c for c in catalog.columns if c not in FIELDS]
    new = rows.select(F.col("path").alias("__path"), *(F.col(c).alias(f"__{c}") for c in FIELDS[1:]), F.lit(True).alias("__is_new"))
    both = catalog.join(new, catalog["path"] == new["__path"], "full_outer")
    pick = [F.when(F.col("__is_new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS]
    return both.select(*kept, *pick).select(*catalog.columns)


def delete(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the paths of `gone`: exactly these, nothing below."""
    return catalog.join(gone.select("path"), "path", "left_anti").select(*catalog.columns)


def delete_subtree(catalog: DataFrame, root: str) -> DataFrame:
    return catalog.filter(~paths.under(F.col("path"), root))


def unknown(scanned: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scanned rows that the catalog doesn't have."""
    return scanned.join(catalog.select("path"), "path", "left_anti").select(*scanned.columns)


def vanished(catalog: DataFrame, scanned: DataFrame, absent_roots: list[str] = ()) -> DataFrame:
    """Catalog rows that a scan didn't find; rows below roots that can't be reached are left alone."""
    reachable = catalog.filter(~paths.under_any(F.col("path"), list(absent_roots))) if absent_roots else catalog
    return reachable.join(scanned.select("path"), "path", "left_anti").select(*catalog.columns)


def sweep_share(catalog: DataFrame, sweep: int, sweeps: int) -> DataFrame:
    """The rows that sweep number `sweep` of `sweeps` looks at."""
    return catalog.filter(F.pmod(F.xxhash64("path"), F.lit(sweeps)) == sweep % sweeps)


def assign_ids(rows: DataFrame, above: int, buckets: int | None = None) -> DataFrame:
    """Rows with `id` from above + 1 on, gapless, by hash bucket and path: no task numbers all rows.

    buckets: by default some for each task of a shuffle, of which a job over more rows has more.
    """
    buckets = buckets or max(1024, 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    held = dealt.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # over `buckets` rows
    held = held.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("path"))
    numbered = dealt.withColumn("__rank", rank).join(F.broadcast(held), "__bucket")  # at most `buckets` rows
    return numbered.withColumn("id", F.lit(above) + F.col("__before") + F.col("__rank")).drop("__bucket", "__rank", "__before")


def high_water(catalog: DataFrame, stored: int = 0) -> DataFrame:
    """The largest id ever given: max_id. Ids of deleted rows aren't given again."""
    return catalog.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(stored)).alias("max_id"))


def merge_roots(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, path, state): stored roots that are still configured, and configured ones that are new. Matched by name."""
    kept = stored.join(configured.select("name"), "name", "left_semi").withColumn("state", F.lit("kept"))
    new = configured.join(stored.select("name"), "name", "left_anti").withColumn("state", F.lit("new"))
    return kept.select("name", "path", "state").unionByName(new.select("name", "path", "state"))


def mounts(text_lines: DataFrame) -> DataFrame:
    """(line, mount, fs) from the lines of a mount table (line, value)."""
    parts = F.split("value", r"\s+")
    return text_lines.select("line", F.get(parts, F.lit(1)).alias("mount"), F.get(parts, F.lit(2)).alias("fs")).filter("mount is not null and fs is not null")


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to be broadcast if it is seen to have at most `most` rows; else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def mount_of(rows: DataFrame, mount_table: DataFrame) -> DataFrame:
    """path, fs, is_network: the file system of the innermost mount that holds the path; of equal mounts the later line.

    A join on ancestors, so that it stays an equi-join however many mounts there
    are; a table of few mounts is broadcast, so that "/" isn't one task's key.
    """
    own = F.array_union(F.array(F.col("path"), F.lit("/")), paths.ancestors(F.col("path")))
    held = rows.select("path").distinct().select("path", F.explode(own).alias("mount"))
    last = mount_table.withColumn("mount", F.when(F.col("mount") == "/", "/").otherwise(F.rtrim("mount", F.lit("/"))))
    found = held.join(small(last), "mount").groupBy("path").agg(F.max_by("fs", F.struct(F.length("mount"), "line")).alias("fs"))
    return rows.select("path").join(found, "path", "left").select("path", "fs", F.coalesce(F.col("fs").isin(*NETWORK_TYPES), F.lit(False)).alias("is_network"))


def tag_store_roots(catalog: DataFrame) -> DataFrame:
    """root: the trees that hold a tag store, distinct and in order."""
    found = catalog.select(paths.tag_store_root(F.col("path")).alias("root")).filter("root is not null")
    return found.distinct().orderBy("root")


def discover_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the innermost tag store root at or above each path."""
    own = F.array_append(paths.ancestors(F.col("path")), F.col("path"))
    held = rows.select("path", F.explode(own).alias("root"))
    return held.join(small(roots.select("root").distinct()), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
