"""Source divergence audit: how the term distribution of each source of a language departs from the others and from the whole.

1. A lookup table over the UTF-8 bytes of a slice of documents finds the
   terms; xxhash groups them, verified byte by byte (bytetokens.py). A slice
   gives (lang, source, term) with occurrences and documents, summed by Spark.
2. A term stays in a language where enough documents hold it. What stays is
   dealt by (lang, term) and sorted: a task reads it as CSR rows, one a term,
   with the sources as columns.
3. A pair of sources differs from "neither has the term" only where one of them
   has it. With p0 for the value of an absent term, the sum over all terms is
       sum over the terms of g of f(p, p0 of h) + sum over the terms of h of f(p0 of g, q)
       + (V - terms of g - terms of h) * f(p0 of g, p0 of h)
       + sum over the terms of both of f(p, q) - f(p, p0) - f(p0, q) + f(p0, p0),
   the first three from counts of counts, the last from the CSR rows: the
   entries of a row are paired, sorted by pair and summed by reduceat. Work grows
   with the entries that meet, not with sources squared times terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetokens as bt
from . import textkit as tk
from .session import n_partitions, stage

ONE = 1_000_000_000
COUNTED = "lang string, source string, term string, n long, n_docs long"


def _slice_terms(buf: np.ndarray, offsets: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, term, occurrences) of the distinct terms of each document, and the terms."""
    if len(buf) <= 2 * target:
        low = tk.lower(buf)
        start, end, first = bt.spans(bt.IS_TERM[buf], offsets)
        ids, rep = bt.group(low, start, end)
        pair, n = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * max(len(rep), 1) + ids, return_counts=True)
        return pair // max(len(rep), 1), pair % max(len(rep), 1), n, [low[s:e].tobytes() for s, e in zip(start[rep], end[rep])]
    total: Counter[bytes] = Counter()  # one long document, piece by piece
    for _, piece, at in tk.word_pieces(buf, offsets, target, ~bt.IS_TERM):
        _, term, n, terms = _slice_terms(piece, at, len(piece))
        for t, k in zip(term.tolist(), n.tolist()):
            total[terms[t]] += k
    return np.zeros(len(total), np.int64), np.arange(len(total)), np.array(list(total.values()), np.int64), list(total)


def _count(batches, target: int = 1 << 21):
    for batch in batches:
        for part in tk.slices(batch, "text", target):
            doc, term, n, terms = _slice_terms(*tk.flat(part.column("text")), target)
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            width = len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
            key = group[doc] * max(len(terms), 1) + term
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            if not len(start):
                continue
            group, term = key[start] // len(terms), key[start] % len(terms)
            columns = [
                lang.dictionary.take(pa.array(group // width)),
                source.dictionary.take(pa.array(group % width)),
                pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(term)),
                pa.array(np.add.reduceat(n, start)),
                pa.array(np.diff(np.append(start, len(key)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])
    tk.release()


def share(n: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exact while total + terms < 9 * 10**15."""
    rest, out, all_ = n + 1, np.zeros(len(n), np.int64), total + terms
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // all_
        rest = rest % all_
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def row_pairs(row: np.ndarray, at_once: int = 1 << 20):
    """(i, j) of all different entries of the same row, rows sorted: blocks of about at_once pairs, a long row in several."""
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(start, len(row)))
    first, per = np.repeat(start, size), np.repeat(size, size)
    ends, at = np.cumsum(per), 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, side="right")))
        i = np.repeat(np.arange(at, stop), per[at:stop])
        j = np.arange(len(i)) - np.repeat(np.cumsum(per[at:stop]) - per[at:stop], per[at:stop]) + np.repeat(first[at:stop], per[at:stop])
        yield i[i != j], j[i != j]
        at = stop


def _meet(batches, at_once: int = 1 << 18):
    """Rows (lang, term, source, n, total, terms) sorted by (lang, term): what the terms that two sources both have add to a pair's sum."""
    names = ["lang", "term", "source", "n", "total", "terms"]

    def solve(rows: pa.Table):
        lang, term, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        lang, term, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, term, source))
        n, total, terms = (rows.column(c).to_numpy() for c in ("n", "total", "terms"))
        p, p0 = share(n, total, terms), share(np.zeros_like(n), total, terms)
        langs, at = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
        width = len(source.dictionary)
        key, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in row_pairs(langs * len(term.dictionary) + term.indices.to_numpy()):
            if not len(i):
                continue
            k = (langs[i] * width + at[i]) * width + at[j]
            order = np.argsort(k, kind="stable")
            i, j, k = i[order], j[order], k[order]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            f = gap(p[i], p[j]) - gap(p[i], p0[j]) - gap(p0[i], p[j]) + gap(p0[i], p0[j])
            key.append(k[starts])
            value.append(np.add.reduceat(f, starts))
        key, value = np.concatenate(key), np.concatenate(value)
        columns = [lang.dictionary.take(pa.array(key // width // width)), source.dictionary.take(pa.array(key // width % width)), source.dictionary.take(pa.array(key % width)), pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch.select(names)])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows < at_once:
            continue
        last = pa.compute.and_(pa.compute.equal(held["lang"], held["lang"][-1]), pa.compute.equal(held["term"], held["term"][-1]))
        cut = held.num_rows - pa.compute.sum(last).as_py()  # the last term may go on
        if cut:
            yield solve(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield solve(held)
    tk.release()


def _p(n: str, total: str) -> F.Column:
    return F.expr(f"1 + (cast({n} + 1 as decimal(19, 0)) * {ONE}) div cast({total} + terms as decimal(19, 0))")


def _gap(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair`, each other source of the language with the sum of gaps; part `term`, the `top` terms
    that the source has more of than its language, with their gaps.

    A gap of shares p and q is floor((p - q)^2 / q); a share is 1 + floor(10^9 *
    (n + 1) / (all + V)), V the terms of the language that at least `least_docs`
    of its rows hold. Null text, lang and source count as ''. Each row is a
    document, repeated ones too. A group without terms still gives its
    share of each kept term; where V is 0 pairs have value 0. Ties go by item in
    UTF-8 order. A source alone in its language has no pairs. Other columns and
    doc_id aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(plain("lang"), plain("source"), plain("text"))
    counted = rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    term = Window.partitionBy("lang", "term")
    counted = counted.select("*", F.sum("n_docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("lang_n"), F.row_number().over(term.orderBy("source")).alias("place"))
    kept = stage(counted.filter(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).alias("lead")), "kept-terms")

    # One row a source of a language: small, and joined by Spark's own size check.
    of_lang = kept.groupBy("lang").agg(F.sum(F.when(F.col("lead"), 1).otherwise(0)).alias("terms"), F.sum("n").alias("lang_total"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "held", "terms", "lang_total"])
    groups = stage(groups, "groups")

    wide = kept.join(groups, ["lang", "source"])
    best = wide.withColumn("p", _p("n", "total")).withColumn("q", _p("lang_n", "lang_total")).filter("p > q")
    best = best.select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    met = wide.select("lang", "term", "source", "n", "total", "terms").repartition(n_partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    met = met.mapInArrow(_meet, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Terms of one side, by how often they occur there: an absent term's share on the other side.
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    counts = counts.withColumn("p", _p("n", "total")).groupBy("lang", "source", "p").agg(F.sum("times").alias("times"))
    empty = groups.filter("terms > 0").withColumn("p0", _p("0", "total"))
    other = empty.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one = counts.join(other, "lang").filter("source <> item")
    out = one.select("lang", "source", "item", (F.col("times") * _gap("p", "q0")).alias("value"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * _gap("q0", "p")).alias("value"))
    neither = empty.join(other.join(groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_there")), ["lang", "item"]), "lang").filter("source <> item")
    neither = neither.select("lang", "source", "item", ((F.col("terms") - F.col("held") - F.col("held_there")) * _gap("p0", "q0")).alias("value"))
    none = groups.filter("terms = 0").select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = out.unionByName(back).unionByName(neither).unionByName(none).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(best, "term"))
