"""Nested folders as intervals of sorted paths: one sweep finds the folder of a table that holds each path.

With "/" as the lowest character a folder and all below it are one interval of
the sorted paths, and intervals nest. Each folder gives two marks: where
it begins, with its own answer, and where it ends, with that of the
folder around it. Sorted together with the marks, a path's answer is that of the
last mark before it. Paths are dealt to stretches, each of which begins at a
mark, and within a stretch by hash to several sweeps that all have the stretch's marks: so
paths are shuffled once, and a folder with most of the paths isn't one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

STRETCHES, SWEEPS = 64, 8
PLACES = 16  # folders a stretch that are looked at to choose where stretches begin


def key(path: Column) -> Column:
    """Sorts a folder right before what is below it, and both together. "/" itself holds every absolute path."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path != "", F.replace(bare, F.lit("/"), F.lit("\0")))


def _fresh(rows: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def marks(folders: DataFrame, innermost: bool = False) -> DataFrame:
    """(at, end, answer) of folders (ord, value, path): two marks each, answer a struct of the value.

    The answer inside a folder is the value of the first folder, by ord, of it and
    all around it; innermost: its own. Of folders with the same path the first
    by ord counts; those without a path don't.
    """
    known = folders.filter("path is not null and path <> ''").select(F.regexp_replace("path", "/+$", "").alias("bare"), "ord", "value")
    known = known.groupBy("bare").agg(F.min(F.struct("ord", "value")).alias("own"))
    # "/" has no bare path, and stands above all others
    above = F.when(F.col("bare") != "", F.array_append(paths.ancestors(F.col("bare")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    around = known.select("bare", F.explode(above).alias("up")).join(known.select(F.col("bare").alias("up"), F.col("own").alias("theirs")), "up")
    around = around.groupBy("bare").agg(F.min("theirs").alias("least"), F.max_by("theirs", F.length("up")).alias("next"), F.max(F.struct(F.length("up").alias("n"), "up")).alias("parent"))
    joined = known.join(around, "bare", "left")
    inside = F.col("own") if innermost else F.least("own", "least")
    full = joined.select("bare", inside["value"].alias("value"), F.col("parent.up").alias("parent"))
    outside = full.select(F.col("bare").alias("parent"), F.struct(F.lit(True).alias("held"), F.col("value")).alias("outer"))
    full = full.join(outside, "parent", "left")
    begin = F.replace("bare", F.lit("/"), F.lit("\0"))
    none = F.struct(F.lit(False).alias("held"), F.lit(None).cast(full.schema["value"].dataType).alias("value"))
    start = F.struct(begin.alias("at"), F.lit(False).alias("end"), F.struct(F.lit(True).alias("held"), F.col("value")).alias("answer"))
    end = F.struct(F.concat(begin, F.lit("\x01")).alias("at"), F.lit(True).alias("end"), F.coalesce("outer", none).alias("answer"))
    return full.select(F.inline(F.array(start, end)))


def _stretch(at: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or before a key: a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(at >= F.lit(bounds[middle]), tree(middle + 1, hi)).otherwise(tree(lo, middle))

    return tree(0, len(bounds))


def _bounds(folders: DataFrame, stretches: int) -> list[str]:
    """Sorted keys of some folders, evenly apart: one reading of the folders and no join. Any folders would do; these only make stretches even."""
    known = folders.filter("path is not null and path <> ''")
    drawn = known.select(key(F.col("path")).alias("at"), F.xxhash64("path", "ord").alias("draw")).orderBy("draw").limit(PLACES * stretches).collect()
    places = sorted({r["at"] for r in drawn})
    return places[:: -(-len(places) // stretches)] if places else []


def holder(rows: DataFrame, folders: DataFrame, name: str, innermost: bool = False, sweeps: int = SWEEPS, stretches: int = STRETCHES) -> DataFrame:
    """rows (path, ...) with `name`: the value of the first folder, by ord, of those (ord, value, path) that hold the path; null if none.

    Folders hold themselves and what is below them; trailing slashes don't count.
    A null or empty path is held by none, a relative one by folders of its own begin only. Rows
    that repeat keep their number.
    """
    spots = marks(folders, innermost)  # two rows a folder
    bounds = _bounds(folders, stretches)
    at, kind, stretch, sweep, row, answer = _fresh(rows, "at", "kind", "stretch", "sweep", "row", "answer")
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(row)
    dealt = rows.select(key(F.col("path")).alias(at), F.lit(2).alias(kind), F.pmod(F.xxhash64("path"), F.lit(sweeps)).cast("int").alias(sweep), F.lit(True).alias("is_row"), whole)
    copied = spots.select(F.col("at").alias(at), F.when(F.col("end"), 0).otherwise(1).alias(kind), F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))).alias(sweep), F.lit(False).alias("is_row"), F.col("answer").alias(answer))
    both = dealt.unionByName(copied, allowMissingColumns=True).withColumn(stretch, _stretch(F.col(at), bounds))
    order = Window.partitionBy(stretch, sweep).orderBy(at, kind).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn(answer, F.last(answer, ignorenulls=True).over(order)).filter("is_row")
    return swept.select(f"{row}.*", F.col(answer)["value"].alias(name))
