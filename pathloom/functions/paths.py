"""Column builders over catalog paths; all of them stay inside whole-stage code generation unless noted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder a path stands in; empty for a path without a slash."""
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(name(path)) - 1, F.lit(0)))


def has_extension(filename: Column) -> Column:
    """A dot anywhere but at the start. The text after the last dot may be empty."""
    return F.locate(".", filename, 2) > 0


def extension(path: Column) -> Column:
    """Text after the last dot of the name, or null."""
    own = name(path)
    return F.when(has_extension(own), F.substring_index(own, ".", -1))


def stem(path: Column) -> Column:
    own = name(path)
    cut = F.length(own) - F.length(F.substring_index(own, ".", -1)) - 1
    return F.when(has_extension(own), F.substring(own, F.lit(1), cut)).otherwise(own)


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or below it. The root's trailing slashes don't count; an empty root holds nothing."""
    if not root:
        return F.lit(False)
    bare = root.rstrip("/")
    if not bare:
        return F.startswith(path, F.lit("/"))
    return (path == bare) | F.startswith(path, F.lit(bare + "/"))


def under_any(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | under(path, root)
    return out


def first_root(path: Column, roots: list[tuple[str, str]]) -> Column:
    """Name of the first root (name, path) that holds the path, or null."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(under(path, p), F.lit(n)) for n, p in roots))


def ancestors(path: Column) -> Column:
    """Proper ancestors of an absolute path, from the top one down. (Lambda: not generated code.)"""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ).otherwise(F.array().cast("array<string>"))


def relative(path: Column, root: str) -> Column:
    """Path below a tag root; null for the root itself, for anything outside and for the tag store's own files."""
    bare = root.rstrip("/")
    rel = F.substring(path, F.lit(len(bare) + 2), F.length(path))
    own = (rel == ".tagstore") | F.startswith(rel, F.lit(".tagstore/"))
    return F.when(F.startswith(path, F.lit(bare + "/")) & (rel != "") & ~own, rel)


def segments_pattern(segments: tuple[str, ...]) -> str:
    """Pattern on the lower-cased path: folders that hold all but the last segment, in order, one folder each."""
    return "(?s)^" + "".join(rf"(?:.*/)?[^/]*{re.escape(s.lower())}[^/]*/" for s in segments[:-1])


def in_segments(path: Column, segments: tuple[str, ...]) -> Column:
    low = F.lower(path)
    return F.contains(name(low), F.lit(segments[-1].lower())) & low.rlike(segments_pattern(segments))


def tag_store_root(path: Column) -> Column:
    """The tree of the first "/.tagstore" in a path, if that is a whole component; else null."""
    at = F.locate("/.tagstore", path)
    after = F.substring(path, at + len("/.tagstore"), F.lit(1))
    return F.when((at > 0) & ((after == "") | (after == "/")), F.substring(path, F.lit(1), at - 1))
