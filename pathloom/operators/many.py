"""Many searches in one pass over the catalog.

The lines are parsed on the driver. An automaton over one text of each (of its
parts, where typos are allowed) finds, in one walk along a path, the lines that
may match; for those pairs the whole predicate is evaluated with the line's
parts as columns, and each line keeps its first rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..plans import compile as plan
from ..plans import patterns
from ..plans.language import FOLDERS, FUZZY, GLOB, REGEX, SUBSTRING, Query, Sort, parse
from .search import DEFAULT_RESULTS, MOST_RESULTS, Roots, attribute

LINES = 1000  # of one pass

PARAMETERS = (
    "at int, request string, mode string, kind string, ext string, low string, dirs string, last string, pattern string, "
    "masks map<string, bigint>, distance int, sort int"
)


def literals(query: Query) -> list[str]:
    """Lower-cased texts of which a matching path has at least one in it; none: any path may match."""
    if query.mode == FUZZY:
        pieces = plan.typo_pieces(query.text.lower(), query.distance)
        return pieces if all(pieces) else []
    if query.mode == SUBSTRING:
        texts = [query.text.lower(), *(s.lower() for s in query.segments or ())]
    else:
        texts = patterns.required_literals(query.text) if query.mode == REGEX else patterns.glob_literals(query.text)
    if query.extension is not None:
        texts = [*texts, "." + query.extension.lower()]
    return [max(texts, key=len)] if any(texts) else []


def parameters(at: int, request: str, query: Query) -> tuple:
    """What a query's predicate needs, as a row of PARAMETERS."""
    low, fuzzy = query.text.lower(), query.mode == FUZZY
    pattern = patterns.java_regex(query.text) if query.mode == REGEX else patterns.glob_regex(f"*{query.text}*") if query.mode == GLOB else None
    dirs = paths.segments_pattern(query.segments) if query.segments else None
    last = query.segments[-1].lower() if query.segments else None
    masks = plan.letter_masks(low) if fuzzy and len(low) <= plan.MOST_BITS else None
    return at, request, query.mode, query.kind, query.extension.lower() if query.extension is not None else None, low, dirs, last, pattern, masks, query.distance, int(query.sort)


def predicate() -> Column:
    """plan.row_filter, with the query's parts in columns; for queries in typos of at most plan.MOST_BITS characters."""
    c = F.col
    path, low_path = c("path"), F.lower("path")
    ext = F.lower(paths.extension(path))
    name, stem = paths.name(low_path), F.lower(paths.stem(path))
    kind = (
        F.when(c("kind") == FOLDERS, c("is_dir"))
        .when(c("kind") == plan.FILES, ~c("is_dir"))
        .when(c("kind") == plan.EDIT, ~c("is_dir") & ~F.coalesce(ext.isin(plan.BINARY_EXTENSIONS), F.lit(False)))
        .otherwise(True)
    )
    extension = c("ext").isNull() | F.coalesce(ext == c("ext"), F.lit(False))
    where = F.when(c("kind") == FOLDERS, name).otherwise(low_path)
    plain = F.contains(where, c("low")) & (c("last").isNull() | (F.contains(name, c("last")) & F.rlike(low_path, c("dirs"))))
    n = F.length("low")
    near = F.when(c("distance") == 0, (F.length(stem) <= n) & (stem == c("low"))).when(F.length(stem) <= n, F.levenshtein("low", stem) <= c("distance"))
    near = near.otherwise(plan.holds_nearly(stem, c("masks"), n, c("distance")))
    text = (
        F.when(c("mode") == REGEX, F.rlike(path, c("pattern")))
        .when(c("mode") == GLOB, F.rlike(paths.name(path), c("pattern")) | F.rlike(path, c("pattern")))
        .when(c("mode") == FUZZY, (c("low") == "") | F.contains(name, c("low")) | near)
        .otherwise(plain)
    )
    return kind & extension & text


class _Automaton:
    """The lines that a text may match, by what it holds."""

    def __init__(self, wanted: list[list[str]]):
        self.always = [i for i, texts in enumerate(wanted) if not texts]
        self.words: dict[str, list[int]] = {}
        for i, texts in enumerate(wanted):
            for text in texts:
                self.words.setdefault(text, []).append(i)

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, line) of all that may match, each once."""
        automaton = ahocorasick.Automaton()
        for word, lines in self.words.items():
            automaton.add_word(word, lines)
        if self.words:
            automaton.make_automaton()
        row, line = [], []
        for i, text in enumerate(texts):
            found = set(self.always)
            if self.words:
                for _, lines in automaton.iter(text):
                    found.update(lines)
            row += [i] * len(found)
            line += found
        return np.array(row, dtype=np.int64), np.array(line, dtype=np.int32)


def _meet(batches: Iterator[pa.RecordBatch], automaton: _Automaton, at_once: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            row, line = automaton.pairs(part.column("low_path").to_pylist())
            kept = part.select([n for n in part.schema.names if n != "low_path"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(line)], names=[*kept.schema.names, "at"])


def search_lines(catalog: DataFrame, lines: list[tuple[str, str]], roots: Roots, most: int = DEFAULT_RESULTS) -> DataFrame:
    """request, rank, path, is_dir, mtime, size, bookmark for (request, line) pairs, all in one pass: the rows of search_all for each line.

    Tags of a line aren't looked at; the order by use counts every use as none.
    """
    spark = catalog.sparkSession
    queries = [(request, parse(line)) for request, line in lines]
    for _, q in queries:
        if q.mode == FUZZY and len(q.text) > plan.MOST_BITS:
            raise ValueError(f"typos are looked for in at most {plan.MOST_BITS} characters here")
    automaton = _Automaton([literals(q) for _, q in queries])
    rows = attribute(catalog.select("path", "is_dir", "mtime", "size"), roots)
    met = rows.withColumn("low_path", F.lower("path")).mapInArrow(lambda it: _meet(it, automaton), "path string, is_dir boolean, mtime long, size long, bookmark string, at int")
    known = spark.createDataFrame([parameters(i, request, q) for i, (request, q) in enumerate(queries)], PARAMETERS)
    found = met.join(F.broadcast(known), "at").filter(predicate())  # the lines of one pass, in memory anyway
    number = {Sort.NEWEST: -F.col("mtime"), Sort.OLDEST: F.col("mtime"), Sort.LARGEST: -F.col("size"), Sort.SMALLEST: F.col("size")}
    by = F.lit(0).cast("long")
    for sort, key in number.items():
        by = F.when(F.col("sort") == int(sort), key).otherwise(by)
    name = lambda sort: F.when(F.col("sort") == int(sort), paths.name(F.col("path"))).otherwise("")
    order = Window.partitionBy("at").orderBy(by, name(Sort.NAME).asc(), name(Sort.NAME_DOWN).desc(), F.col("path"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(most, MOST_RESULTS)))
    return ranked.select("request", "rank", "path", "is_dir", "mtime", "size", "bookmark")


def search_many(catalog: DataFrame, requests: DataFrame, roots: Roots, most: int = DEFAULT_RESULTS, lines: int = LINES) -> DataFrame:
    """search_lines for a table of requests (request, line), so many lines to a pass."""
    out, block = None, []

    def add(out, block):
        more = search_lines(catalog, block, roots, most)
        return more if out is None else out.unionByName(more)

    for r in requests.select("request", "line").toLocalIterator():
        block.append((r.request, r.line))
        if len(block) == lines:
            out, block = add(out, block), []
    return add(out, block) if block or out is None else out
