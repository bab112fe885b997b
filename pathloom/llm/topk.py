"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are dealt to a grid: a cell holds one block of queries
and one block of candidates, and gives each of its queries its k best there.
Within a cell vectors are held dimension by dimension. Sums grow block by block
of dimensions; after each block a candidate stays only if its sum plus the most
that the remaining dimensions can add (the product of the remaining norms)
reaches the k-th best score so far, and the survivors are compacted.

Arithmetic is exact. Components are whole numbers. While no sum can pass 2**53,
doubles hold every sum; beyond, sums are 64-bit integers, and where these could
overflow, whole numbers of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .session import n_partitions, stage

PAIRS = "query_row long, query_id long, vec_id long, high decimal(38,0), score long"
LARGEST = 2**63 - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double, exact; null where the vector can't take part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def down(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    return F.when(usable, F.transform(vector, down))


def _norm(columns: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((columns * columns).sum(axis=0))


def _whole(columns: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python integers."""
    return np.array([int(x) for x in columns.ravel()], dtype=object).reshape(columns.shape)


class Search:
    """Running top-k of a block of queries of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, step: int):
        self.rows, self.ids, self.vectors, self.k, self.step = rows, ids, vectors, k, step
        self.norm = _norm(vectors.T)
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def add(self, rows: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        """columns: dims x candidates. Candidates and queries of about one size go together, so that few need long arithmetic."""
        norm = _norm(columns)
        size = np.digitize(norm, [2.0**26, 2.0**31])
        asked = np.digitize(self.norm, [2.0**26, 2.0**31])
        for a in np.unique(asked):
            for b in np.unique(size):
                mine, theirs = np.flatnonzero(asked == a), np.flatnonzero(size == b)
                most = self.norm[mine].max() * norm[theirs].max()
                kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
                # sums that no double holds aren't bounded, only added up
                self._add(mine, rows[theirs], ids[theirs], columns[:, theirs], kind, most < 1e150)

    def _add(self, mine: np.ndarray, rows: np.ndarray, ids: np.ndarray, columns: np.ndarray, kind, prune: bool) -> None:
        order = np.argsort(-_norm(columns.T), kind="stable")  # heavy dimensions first
        columns, queries = np.ascontiguousarray(columns[order]), self.vectors[np.ix_(mine, order)]
        starts = list(range(0, len(columns), self.step)) or [0]
        ends = [*starts[1:], len(columns)]
        left_c = [_norm(columns[e:]) for e in ends]
        left_q = [_norm(queries[:, e:].T) for e in ends]
        if kind is not np.float64:
            to = _whole if kind is object else lambda x: x.astype(np.int64)
            columns, queries = to(columns), to(queries)
        for i, q in enumerate(mine):
            score, vec = self.best[q]
            floor = score[-1] if prune and len(score) >= self.k and abs(score[-1]) < 1e300 else None
            keep, total = None, np.zeros(len(ids), dtype=kind)
            for b, s in enumerate(starts):
                block = columns[s : s + self.step]
                total = total + queries[i, s : s + self.step] @ (block if keep is None else block[:, keep])
                if floor is None or b + 1 == len(starts):
                    continue
                rest = left_q[b][i] * (left_c[b] if keep is None else left_c[b][keep])
                near = total.astype(np.float64)
                slack = 1e-9 * (np.abs(near) + rest + abs(float(floor))) + 1e-3
                alive = np.flatnonzero(near + rest >= float(floor) - slack)
                if len(alive) < len(total):
                    total, keep = total[alive], alive if keep is None else keep[alive]
                if not len(total):
                    break
            got, row = (ids, rows) if keep is None else (ids[keep], rows[keep])
            other = row != self.rows[q]
            total, got = total[other], got[other]
            if not len(got):
                continue
            total, got = _join(score, total), np.concatenate([vec, got])
            if len(total) > 4 * self.k and total.dtype != object:
                cut = np.partition(total, len(total) - self.k)[len(total) - self.k]
                total, got = total[total >= cut], got[total >= cut]
            if total.dtype == object:
                first = np.array(sorted(range(len(total)), key=lambda j: (-total[j], got[j]))[: self.k], dtype=np.int64)
            else:
                first = np.lexsort((got, -total))[: self.k]
            self.best[q] = total[first], got[first]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two arrays of whole numbers as one, in a type that holds both exactly."""
    if a.dtype == b.dtype or not len(a):
        return np.concatenate([a.astype(b.dtype), b])
    if object in (a.dtype, b.dtype):
        return np.concatenate([a.astype(object) if a.dtype == object else np.array([int(x) for x in a], object), b if b.dtype == object else np.array([int(x) for x in b], object)])
    return np.concatenate([a.astype(np.int64), b.astype(np.int64)])


def _cells(batches, k: int, step: int, rows: int):
    """Rows sorted by cell, the queries of a cell first."""
    cell, searches, asked = None, {}, []

    def begin():
        for d in sorted({len(v) for _, _, v in asked}):
            mine = [x for x in asked if len(x[2]) == d]
            searches[d] = Search(np.array([x[0] for x in mine]), np.array([x[1] for x in mine]), np.array([x[2] for x in mine], np.float64).reshape(len(mine), d), k, step)
        asked.clear()

    def end():
        for search in searches.values():
            for row, own, (score, vec) in zip(search.rows.tolist(), search.ids.tolist(), search.best):
                whole = [int(x) for x in score]
                # high: what passes a long, for the order alone
                yield [(row, own, v, s if abs(s) > LARGEST else None, max(-LARGEST - 1, min(LARGEST, s))) for v, s in zip(vec.tolist(), whole)]
        searches.clear()

    for batch in batches:
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        cells, query, row, ids = (column(c) for c in ("cell", "query", "row", "vec_id"))
        lists = batch.column("v")
        lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(query) != 0)) + 1
        for s, e in zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(cells)).tolist()):
            if s == e:
                continue
            if cells[s] != cell:
                yield from _results(end())
                cell = cells[s]
                asked.clear()
            if query[s]:
                flat = lists.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                asked += zip(row[s:e].tolist(), ids[s:e].tolist(), np.split(flat, np.cumsum(lengths[s:e])[:-1]))
                continue
            begin()
            for d, search in searches.items():
                chosen = s + np.flatnonzero(lengths[s:e] == d)
                for at in range(0, len(chosen), rows):
                    part = chosen[at : at + rows]
                    flat = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    search.add(row[part], ids[part], flat.reshape(len(part), d).T)
    yield from _results(end())
    tk.release()


def _results(queries):
    rows = [r for found in queries for r in found]
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64())
        limit = 10**38 - 1
        rows = [(*r[:3], None if r[3] is None else max(-limit, min(limit, r[3])), r[4]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["query_row", "query_id", "vec_id", "high", "score"])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    query_block: int = 16384,
    candidate_block: int = 65536,
    step: int = 16,
    rows: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows by integer inner product.

    Components become floor(scale * x). Ties go to the smaller vec_id. Null
    vectors, vectors with a null or non-finite component and null ids take no
    part, as query or candidate; vectors of different length don't meet, empty
    ones only each other, at 0. Only a query's own row is left out: another row
    that repeats its vec_id, or an id, is a candidate of its own. Fewer than k
    candidates: all of them. A score beyond a long is given as the longest
    long; the order goes by the true score, up to 38 digits. A component that
    isn't finite once multiplied counts as not finite.

    A task holds one block of about `query_block` queries and the candidates
    slice by slice; nothing is collected or broadcast. Candidates are sent once
    for each block of queries, queries once for each block of candidates.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    given = given.filter("vec_id is not null and v is not null and forall(v, x -> abs(x) < double('inf'))")
    given = stage(given.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_asked = given.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    across = max(1, -(-n_asked // query_block))
    down = max(1, min(n_partitions(spark), -(-n // 1024)), -(-n // candidate_block))
    draw = lambda name, of: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    cell = lambda i, j: (F.col(i) * down + F.col(j)).alias("cell")
    queries = given.filter("asked").withColumn("i", draw("query", across)).withColumn("j", each(down))
    others = given.withColumn("j", draw("candidate", down)).withColumn("i", each(across))
    both = queries.select(cell("i", "j"), F.lit(1).alias("query"), "row", "vec_id", "v").unionByName(others.select(cell("i", "j"), F.lit(0).alias("query"), "row", "vec_id", "v"))
    both = both.repartition(max(n_partitions(spark), min(across * down, 100_000)), "cell").sortWithinPartitions("cell", F.desc("query"))
    found = both.mapInArrow(lambda it: _cells(it, k, step, rows), PAIRS)
    best = Window.partitionBy("query_row").orderBy(F.desc(F.coalesce("high", F.col("score").cast("decimal(38,0)"))), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
