"""Tag entries (root, rel, tags, size, mtime_ns, fp): set changes, queries, repair and check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprint, paths


def _changed(entries: DataFrame, files: DataFrame, tags) -> DataFrame:
    """Entries with new tags where their rel (and root, if files has it) is among `files`; those left bare go."""
    keys = [c for c in ("root", "rel") if c in files.columns]
    hit = files.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = entries.join(hit, keys, "left").withColumn("tags", F.when(F.col("__hit"), F.array_sort(F.array_distinct(tags))).otherwise(F.col("tags")))
    return out.filter(F.size("tags") > 0).select(*entries.columns)


def _array(tags: list[str]):
    return F.array(*map(F.lit, tags)).cast("array<string>")


def add(entries: DataFrame, files: DataFrame, tags: list[str]) -> DataFrame:
    """Entries with the tags added to those of `files` (rel); a file without an entry isn't given one here (see TagStore)."""
    return _changed(entries, files, F.array_union("tags", _array(tags)))


def remove(entries: DataFrame, files: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Without the tags, or without any (None); an entry left bare goes."""
    return _changed(entries, files, _array([]) if tags is None else F.array_except("tags", _array(tags)))


def set_tags(entries: DataFrame, files: DataFrame, tags: list[str]) -> DataFrame:
    return _changed(entries, files, _array(tags))


def find(entries: DataFrame, require: list[str] = (), any_of: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Entries with all of require, one of any_of (if given) and none of exclude; names are exact. In order of rel."""
    own, names = F.col("tags"), lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    keep = F.lit(True)
    for tag in require:
        keep = keep & F.array_contains(own, tag)
    if any_of:
        keep = keep & F.arrays_overlap(own, names(any_of))
    if exclude:
        keep = keep & ~F.arrays_overlap(own, names(exclude))
    return entries.filter(keep).orderBy("rel")


def counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def decorate(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows with tags_text: their tags, comma-joined; empty without."""
    known = entries.select(F.concat("root", F.lit("/"), "rel").alias("__path"), F.array_join("tags", ", ").alias("tags_text"))
    return rows.join(known, rows["path"] == known["__path"], "left").drop("__path").withColumn("tags_text", F.coalesce("tags_text", F.lit("")))


def list_dir(catalog: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """name, is_dir, mtime, size, tags_text of a folder's children, by name; the tag store's own folder is left out."""
    bare = folder.rstrip("/")
    own = F.col("path")
    here = catalog.filter(F.startswith(own, F.lit(bare + "/")) & (paths.parent(own) == bare) & (paths.name(own) != ".tagstore"))
    out = decorate(here, entries)
    return out.select(paths.name(own).alias("name"), "is_dir", "mtime", "size", "tags_text").orderBy("name")


def _loose(entries: DataFrame, disk: DataFrame) -> DataFrame:
    """Untracked files."""
    return disk.join(entries.select("rel"), "rel", "left_anti")


def repair_plan(entries: DataFrame, disk: DataFrame) -> DataFrame:
    """rel, status, new_rel, size, fp for the entries whose file is gone.

    Candidates are untracked files (rel, size, fp) of equal size and
    fingerprint. One candidate: the first entry by rel is relinked, others are
    missing; more: all are ambiguous (see repair_candidates); none: missing.
    Candidates are only counted here, so copies by the million make no long row.
    """
    orphans = entries.join(disk.select("rel"), "rel", "left_anti").select("rel", "size", "fp")
    grouped = _loose(entries, disk).groupBy(F.col("size").alias("__size"), F.col("fp").alias("__fp")).agg(F.count("*").alias("n"), F.min("rel").alias("__only"))
    first = orphans.groupBy("size", "fp").agg(F.min("rel").alias("__first"))
    first = first.join(grouped, (F.col("size") == F.col("__size")) & (F.col("fp") == F.col("__fp"))).select("size", "fp", "n", "__only", "__first")
    met = orphans.join(first, ["size", "fp"], "left")
    status = F.when(F.coalesce("n", F.lit(0)) > 1, "ambiguous").when((F.col("n") == 1) & (F.col("rel") == F.col("__first")), "relinked").otherwise("missing")
    out = met.withColumn("status", status)
    return out.select("rel", "status", F.when(F.col("status") == "relinked", F.col("__only")).alias("new_rel"), "size", "fp")


def repair_candidates(entries: DataFrame, disk: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """size, fp, candidate: the untracked files that ambiguous entries of that size and fingerprint may be; a row each, once for all such entries."""
    plan = repair_plan(entries, disk) if plan is None else plan
    wanted = plan.filter("status = 'ambiguous'").select("size", "fp").distinct()
    return _loose(entries, disk).join(wanted, ["size", "fp"], "left_semi").select("size", "fp", F.col("rel").alias("candidate"))


def refreshed(entries: DataFrame, disk: DataFrame) -> DataFrame:
    """Entries whose file changed in place (size or time), with the file's values: rel, size, mtime_ns, fp."""
    there = disk.select("rel", F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"), F.col("fp").alias("__fp"))
    both = entries.join(there, "rel").filter("size <> __size or mtime_ns <> __mtime")
    return both.select("rel", F.col("__size").alias("size"), F.col("__mtime").alias("mtime_ns"), F.col("__fp").alias("fp"))


def repair(entries: DataFrame, disk: DataFrame, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries after the repair, report): report is rel, status, new_rel, size, fp, status refreshed and pruned included."""
    plan = repair_plan(entries, disk)
    stat = disk.select(F.col("rel").alias("__rel"), F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"), F.col("fp").alias("__fp"))
    placed = entries.join(plan.select("rel", "status", "new_rel"), "rel", "left").withColumn("__to", F.coalesce("new_rel", "rel"))
    both = placed.join(stat, placed["__to"] == stat["__rel"], "left")
    if prune:
        both = both.filter(~F.coalesce(F.col("status") == "missing", F.lit(False)))
    after = both.select(
        "root",
        F.col("__to").alias("rel"),
        "tags",
        F.coalesce("__size", "size").alias("size"),
        F.coalesce("__mtime", "mtime_ns").alias("mtime_ns"),
        F.when(F.col("__rel").isNull() | ((F.col("__size") == F.col("size")) & (F.col("__mtime") == F.col("mtime_ns"))), F.col("fp")).otherwise(F.coalesce("__fp", "fp")).alias("fp"),
    )
    status = F.when((F.col("status") == "missing") & F.lit(prune), "pruned").otherwise(F.col("status"))
    report = plan.withColumn("status", status)
    fresh = refreshed(entries, disk).select("rel", F.lit("refreshed").alias("status"), F.lit(None).cast("string").alias("new_rel"), "size", "fp")
    return after, report.unionByName(fresh)


def check(entries: DataFrame, disk: DataFrame, verify: bool = False) -> DataFrame:
    """rel, status for every entry and untracked file: ok, missing, modified, mismatch (verify), untracked."""
    there = disk.select(F.col("rel").alias("__rel"), F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"), *([F.col("fp").alias("__fp")] if verify else []))
    both = entries.join(there, entries["rel"] == there["__rel"], "full_outer")
    status = F.when(F.col("rel").isNull(), "untracked").when(F.col("__rel").isNull(), "missing")
    status = status.when((F.col("size") != F.col("__size")) | (F.col("mtime_ns") != F.col("__mtime")), "modified")
    if verify:
        status = status.when(~F.col("fp").eqNullSafe(F.col("__fp")), "mismatch")
    return both.select(F.coalesce("rel", "__rel").alias("rel"), status.otherwise("ok").alias("status"))


def check_summary(entries: DataFrame, disk: DataFrame, verify: bool = False) -> DataFrame:
    """One row: entry_count, untracked_count, missing_count, modified_count, mismatch_count."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    return check(entries, disk, verify).agg(
        n("ok", "missing", "modified", "mismatch").alias("entry_count"),
        n("untracked").alias("untracked_count"),
        n("missing").alias("missing_count"),
        n("modified").alias("modified_count"),
        n("mismatch").alias("mismatch_count"),
    )


def with_fingerprints(disk: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """disk (rel, path, size, mtime_ns) with fp: taken over where size and time are those of `known`, else read from the file."""
    old = known.select(F.col("rel").alias("__rel"), F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"), F.col("fp").alias("__fp"))
    both = disk.join(old, disk["rel"] == old["__rel"], "left")
    same = F.coalesce((F.col("size") == F.col("__size")) & (F.col("mtime_ns") == F.col("__mtime")), F.lit(False))
    columns = [c for c in disk.columns if c != "fp"]
    kept = both.filter(same).select(*columns, F.col("__fp").alias("fp"))
    read = both.filter(~same).select(*columns).withColumn("fp", fingerprint.path_fingerprint(F.col(path)))
    return kept.unionByName(read)
