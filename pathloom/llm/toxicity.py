"""Toxicity by nearest labelled examples.

A bounded sample of labelled rows gives (a) the terms: words and word
beginnings that go with label 1 beyond chance (likelihood ratio, held against
the number of terms that were tried), all of them; and (b) examples: TF-IDF
vectors over the terms, idf counted over the whole corpus, equal vectors held
once with their numbers of each label. The examples form a block-max inverted
index: for each term its postings block by block, with the largest weight of
each block. A document meets only blocks that hold one of its terms, in the
order of their bounds, until no bound reaches its k-th best cosine: the k
nearest are exact. Votes weigh by distance and by how many labelled rows an
example stands for. Documents without any such term are held against examples
without any, by all their words and an index of its own: there are few of these
examples, as frequent words meet most of them. Empty texts take their share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .session import discard, held_out, stage

BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
for _a, _b in ((48, 58), (97, 123)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)


def features(texts, beginnings: tuple[int, ...] = BEGINNINGS):
    """(document index, feature hash) of each word and word beginning, as arrays, in pieces of the texts."""
    raw, offsets = tk.flat(texts)
    for base, buf, at in tk.word_pieces(_PLAIN[raw], offsets):
        start, end, first = tk.words(buf, at)
        doc = np.repeat(np.arange(base, base + len(at) - 1), np.diff(first))
        prefix = tk.prefix_hash(buf)
        docs, hashes = [doc], [tk.span_hash(prefix, start, end)]
        for n in beginnings:
            longer = np.flatnonzero(end - start > n)
            docs.append(doc[longer])
            hashes.append(tk.span_hash(prefix, start[longer], start[longer] + n) ^ np.uint64(n))
        yield np.concatenate(docs), np.concatenate(hashes)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by feature and document, each once."""
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _document_frequencies(batches):
    for batch in batches:
        for part in tk.slices(batch, "text"):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = [_distinct(*x) for x in features(part.column("text"))]
            doc, h = _distinct(*(np.concatenate(x) for x in zip(*pieces))) if len(pieces) > 1 else pieces[0]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            if len(at):
                y = label[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(y, at)), pa.array(np.add.reduceat(1 - y, at))], names=["feature", "df1", "df0"]
                )
    tk.release()


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G statistic of terms that a of n1 and b of n0 rows hold; over x with probability exp(-x / 2) at most by chance."""
    a, b, total = a.astype(float), b.astype(float), max(n1 + n0, 1)

    def part(seen, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0.0)

    with_, without = a + b, n1 + n0 - a - b
    return 2 * (part(a, with_ * n1 / total) + part(b, with_ * n0 / total) + part(n1 - a, without * n1 / total) + part(n0 - b, without * n0 / total))


class Vocabulary:
    """Feature hashes to columns, with a bit table that turns most words away."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray | None = None, beginnings: tuple[int, ...] = BEGINNINGS):
        """hashes: ascending."""
        self.hashes, self.idf, self.beginnings = hashes, idf, beginnings
        self.table = np.zeros(1 << 18, dtype=bool)
        self.table[self.hashes >> np.uint64(46)] = True

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(document, column, number of times), by document and column; and the number of documents."""
        cells, n = [np.zeros(0, np.int64)], len(texts)
        for doc, h in features(texts, self.beginnings) if len(self.hashes) else ():
            maybe = np.flatnonzero(self.table[h >> np.uint64(46)])
            doc, h = doc[maybe], h[maybe]
            col = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[col] == h
            cells.append(doc[hit] * len(self.hashes) + col[hit])
        cell, tf = np.unique(np.concatenate(cells), return_counts=True)
        width = max(len(self.hashes), 1)
        return cell // width, cell % width, tf, n

    def vectors(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Normalised TF-IDF in parts (document, column, weight), by document and column; and the number of documents."""
        doc, col, tf, n = self.counts(texts)
        if not len(doc):
            return doc, col, tf, n
        w = (1 + np.log(tf)) * self.idf[col]
        norm = np.sqrt(np.bincount(doc, w * w, minlength=n))
        return doc, col, w / norm[doc], n


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of the ranges [lo, hi) one after the other."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Index:
    """Examples in blocks; see the module's text."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], votes: np.ndarray, ids: np.ndarray, width: int, block: int = 64):
        """vectors: (columns, weights) of each example; votes: labelled rows of label 0 and 1; ids: a document that has the vector."""
        # Examples whose heaviest term is the same stand together, so that few blocks have a large bound.
        lead = np.array([c[np.argmax(w)] for c, w in vectors], dtype=np.int64)
        order = np.argsort(lead, kind="stable")
        self.votes, self.ids, self.block = votes[order], ids[order], block
        size = np.array([len(vectors[i][0]) for i in order], dtype=np.int64)
        example = np.repeat(np.arange(len(order)), size)
        term = np.concatenate([vectors[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if len(order) else np.zeros(0)
        by = np.lexsort((example, term))
        self.example, self.weight, term = example[by], weight[by], term[by]
        # a cell: the postings of one term in one block
        at_block = self.example // block
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (at_block[1:] != at_block[:-1])
        self.cell = np.append(np.flatnonzero(new), len(term))
        self.cell_block = at_block[self.cell[:-1]]
        self.largest = np.maximum.reduceat(self.weight, self.cell[:-1]) if len(term) else self.weight
        self.term = np.searchsorted(term[self.cell[:-1]], np.arange(width + 1))
        self.n_blocks = -(-len(order) // block)

    def nearest(self, query: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, example) of the k nearest of n queries, best first; ties go to the earlier example. Missing: cosine -1."""
        sims, found = np.full((n, k), -1.0), np.zeros((n, k), dtype=np.int64)
        part, cell = _ranges(self.term[col], self.term[col + 1])
        if not len(cell):
            return sims, found
        pair = query[part] * self.n_blocks + self.cell_block[cell]
        by = np.argsort(pair, kind="stable")
        pair, cell, own = pair[by], cell[by], w[part][by]
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        stop = np.append(start[1:], len(pair))
        bound = np.add.reduceat(own * self.largest[cell], start)
        asked, block = pair[start] // self.n_blocks, pair[start] % self.n_blocks
        order = np.lexsort((block, -bound, asked))  # each query's blocks, the largest bound first
        rank = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
        upto, done = 1, 0
        while len(order):
            now = (rank >= done) & (rank < upto)
            open_ = order[now]
            open_ = open_[bound[open_] > sims[asked[open_], -1] - 1e-9]
            for s in range(0, len(open_), 8192):
                self._open(open_[s : s + 8192], asked, block, start, stop, cell, own, sims, found)
            rest = rank >= upto
            order, rank = order[rest], rank[rest]
            alive = bound[order] > sims[asked[order], -1] - 1e-9
            order, rank = order[alive], rank[alive]
            done, upto = upto, upto * 2
        return sims, found

    def _open(self, pairs, asked, block, start, stop, cell, own, sims, found) -> None:
        """Score whole blocks and merge them into the best so far. pairs: by query."""
        which, at = _ranges(start[pairs], stop[pairs])
        inner, posting = _ranges(self.cell[cell[at]], self.cell[cell[at] + 1])
        slot = which[inner] * self.block + self.example[posting] % self.block
        got = np.bincount(slot, own[at][inner] * self.weight[posting], len(pairs) * self.block)
        hit = np.flatnonzero(got > 0)
        query, example = asked[pairs][hit // self.block], block[pairs][hit // self.block] * self.block + hit % self.block
        got = np.round(got[hit], 12)
        mine = np.unique(query)
        k = sims.shape[1]
        query = np.concatenate([query, np.repeat(mine, k)])
        example, got = np.concatenate([example, found[mine].ravel()]), np.concatenate([got, sims[mine].ravel()])
        order = np.lexsort((example, -got, query))
        query, example, got = query[order], example[order], got[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < k
        sims[query[top], rank[top]], found[query[top], rank[top]] = got[top], example[top]


class Voters:
    """Examples of one kind: their terms, their index, and the share of label 1 that a vote begins with."""

    def __init__(self, vocabulary: Vocabulary, index: Index, prior: float):
        self.vocabulary, self.index, self.prior = vocabulary, index, prior

    def score(self, texts, k: int, softness: float):
        """(texts that have a term, their scores, (text, document, share of label 1, cosine, weight) of the voters, by text, the nearest first)."""
        doc, col, w, _ = self.vocabulary.vectors(texts)
        has = np.unique(doc)
        sims, found = self.index.nearest(np.searchsorted(has, doc), col, w, len(has), k)
        votes = self.index.votes[found] if len(self.index.votes) else np.zeros((*found.shape, 2))
        weight = np.where(sims > 0, 1.0 / (1.0 - np.minimum(sims, 1.0) + softness), 0.0)
        for1, all_ = (weight * votes[..., 1]).sum(axis=1), (weight * votes.sum(axis=-1)).sum(axis=1)
        row, rank = np.nonzero(sims > 0)
        own = votes[row, rank]
        ids = self.index.ids[found[row, rank]] if len(row) else np.zeros(0, np.int64)
        return has, (for1 + self.prior) / (all_ + 1.0), (has[row], ids, own[:, 1] / own.sum(axis=1), sims[row, rank], weight[row, rank])


class Model:
    def __init__(self, leaning: Voters, plain: Voters, without: float):
        """leaning: by the terms that go with label 1; plain: by all words, for texts without such a term; without: for texts without any word."""
        self.leaning, self.plain, self.without = leaning, plain, without

    def score(self, texts, k: int, softness: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(score of each text, (text, document, share of label 1, cosine, weight) of the voters, by text, the nearest first)."""
        out = np.full(len(texts), self.without)
        has, score, voters = self.leaning.score(texts, k, softness)
        out[has] = score
        rest = np.setdiff1d(np.arange(len(texts)), has)
        more, score, others = self.plain.score(texts.take(pa.array(rest)), k, softness)
        out[rest[more]] = score
        voters = [np.concatenate(x) for x in zip(voters, (rest[others[0]], *others[1:]))]
        order = np.argsort(voters[0], kind="stable")
        return np.clip(out, 0.0, 1.0), tuple(x[order] for x in voters)


def _word_set(batches):
    for batch in batches:
        for part in tk.slices(batch, "text"):
            found = [h for _, h in features(part.column("text"), ())]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["feature"])
    tk.release()


def _document_counts(docs: DataFrame, vocabularies: list[Vocabulary]) -> tuple[int, list[np.ndarray]]:
    """(rows of docs, for each vocabulary how many rows hold each of its terms): one scan of all texts."""
    start = np.concatenate([[0], np.cumsum([len(v.hashes) for v in vocabularies])])

    def count(batches):
        total, rows = np.zeros(start[-1] + 1, dtype=np.int64), 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                for v, at in zip(vocabularies, start):
                    _, col, _, n_docs = v.counts(part.column("text"))
                    total += np.bincount(col + at, minlength=len(total))
                rows += n_docs
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["col", "n"])
        tk.release()

    got = docs.select("text").mapInArrow(count, "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(start[-1] + 1, dtype=np.int64)
    total[got.column("col").to_numpy()] = got.column("n").to_numpy()
    return int(total[-1]), [total[a:b] for a, b in zip(start[:-1], start[1:])]


def _vectors(sample: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """label, doc_id, col, w of sample (label, doc_id, text)."""

    def of(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                doc, col, w, n_docs = vocabulary.vectors(part.column("text"))
                at = pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (col, np.round(w, 12))]
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("doc_id"), *lists], names=["label", "doc_id", "col", "w"])

    return sample.select("label", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "label int, doc_id long, col array<long>, w array<double>")


def _index(vectors: DataFrame, per: np.ndarray, width: int) -> tuple[Index, np.ndarray]:
    """(the index of equal vectors with their votes, the votes of those without any term). per: labelled rows that an example of each label stands for."""
    got = vectors.groupBy("col", "w").agg(*(F.count(F.when(F.col("label") == y, 1)).alias(f"n{y}") for y in (0, 1)), F.min("doc_id").alias("doc_id"))
    none, rows = np.zeros(2), []
    for r in got.collect():  # an example each at most, of bounded texts
        votes = np.array([r["n0"], r["n1"]]) * per
        if r["col"]:
            rows.append((r["col"], r["w"], votes, r["doc_id"]))
        else:
            none += votes
    rows.sort(key=lambda r: (r[0], r[1]))
    index = Index([(np.array(c), np.array(w)) for c, w, _, _ in rows], np.array([r[2] for r in rows]).reshape(len(rows), 2), np.array([r[3] for r in rows], dtype=np.int64), width)
    return index, none


def _bounded(sample: DataFrame, most_bytes: int) -> DataFrame:
    """Staged: the texts of a sample (label, doc_id, text) of some thousand ids, by hash, as far as they take most_bytes together; of an id the smallest text."""
    once = stage(sample.groupBy("label", "doc_id").agg(F.min("text").alias("text")), "toxic-texts")
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over ids and sizes
    kept = once.select("label", "doc_id", F.octet_length("text").alias("n")).withColumn("upto", upto).filter(F.col("upto") <= most_bytes)
    out = stage(once.join(F.broadcast(kept.select("label", "doc_id")), ["label", "doc_id"]), "toxic-sample")
    discard(once)
    return out


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, most_examples: tuple[int, int] = (16384, 4096), most_plain: tuple[int, int] = (448, 64), most_bytes: int = 256 << 20, chance: float = 0.01, lift: float = 4.0) -> Model:
    """The model of labelled rows that aren't held out.

    most_examples: of label 0 and of label 1 at most so many labelled ids are
    used, those of the smallest hash, as far as their texts (the smallest, where an id has
    several) take most_bytes together; most_plain: so many of those without a term that goes
    with label 1, and a sixteenth of most_bytes, for texts that have none either. These bounds hold for what the driver holds and what
    is broadcast: terms, postings and examples all come from the sampled texts. chance: the
    number of terms expected to enter without going with label 1; lift: how many
    times as often rows of label 1 must hold a term, so that no frequent word
    enters for a slight leaning. The idf is counted over all rows of docs.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), modulus, remainder))
    marked = marked.groupBy("doc_id").agg(F.when(F.avg("toxic") >= 0.5, 1).otherwise(0).alias("label"))
    marked = stage(marked, "toxic-labels")
    size = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = lambda y: marked.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples[y])
    picked = pick(0).unionByName(pick(1))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = _bounded(own.join(F.broadcast(picked), "doc_id"), most_bytes)  # at most sum(most_examples) ids
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    per = np.array([size.get(0, 0) / max(n0, 1), size.get(1, 0) / max(n1, 1)])  # labelled rows that an example stands for
    prior = size.get(1, 0) / max(1, size.get(0, 0) + size.get(1, 0))

    counted = sample.select("label", "text").mapInArrow(_document_frequencies, "feature long, df1 long, df0 long")
    counted = stage(counted.groupBy("feature").agg(F.sum("df1").alias("a"), F.sum("df0").alias("b")), "toxic-terms")
    tried = counted.count()
    leaning = counted.filter(F.expr(f"a * {float(n0)} >= {lift} * b * {float(n1)} and a > 1")).toArrow()
    a, b = leaning.column("a").to_numpy(), leaning.column("b").to_numpy()
    beyond = likelihood_ratio(a, b, n1, n0) > 2 * np.log(max(tried, 1) / chance)
    vocabulary = Vocabulary(np.sort(leaning.column("feature").to_numpy()[beyond].view(np.uint64)))
    # Which texts hold none of the terms needs no weights.
    vocabulary.idf = np.ones(len(vocabulary.hashes))
    lone = stage(_vectors(sample, vocabulary).filter("size(col) = 0").select("label", "doc_id"), "toxic-lone")
    n_lone = {r["label"]: r["n"] for r in lone.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = lambda y: lone.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_plain[y])
    chosen = some(0).unionByName(some(1)).withColumnRenamed("doc_id", "own")
    plain = sample.join(F.broadcast(chosen), (F.col("doc_id").cast("long") == F.col("own")) & (sample["label"] == chosen["label"])).select(sample["label"], "doc_id", "text")  # at most sum(most_plain) ids
    plain = _bounded(plain, most_bytes // 16)
    n_plain = {r["label"]: r["n"] for r in plain.groupBy("label").agg(F.count("*").alias("n")).collect()}
    words = plain.select("text").mapInArrow(_word_set, "feature long").distinct().toArrow()  # words of bounded texts
    words = Vocabulary(np.sort(words.column("feature").to_numpy().view(np.uint64)), beginnings=())
    rows, held = _document_counts(own, [vocabulary, words])
    for v, df in zip((vocabulary, words), held):
        v.idf = np.log((1 + rows) / (1 + df)) + 1
    index, none = _index(_vectors(sample, vocabulary), per, len(vocabulary.hashes))
    without = float((none[1] + prior) / (none.sum() + 1.0))
    per_plain = per * np.array([n_lone.get(y, 0) / max(n_plain.get(y, 0), 1) for y in (0, 1)])
    plain_index, _ = _index(_vectors(plain, words), per_plain, len(words.hashes))
    discard(marked, sample, counted, lone, plain)
    return Model(Voters(vocabulary, index, float(prior)), Voters(words, plain_index, without), without)


EVIDENCE = "array<struct<doc_id: long, toxic: double, cosine: double, weight: double>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, k: int = 16, softness: float = 0.05, modulus: int = 5, remainder: int = 0, evidence: int = 3, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs (doc_id, text).

    labels: (doc_id, toxic); rows with a null are left out, an id labelled more
    than once takes the majority (a tie counts as 1). Ids whose crc32 leaves
    `remainder` are never learned from. Null and empty texts have no terms.
    Without any usable label all scores are 0. Rows that repeat are scored
    each; a row's score depends on its text, the model and the corpus's idf. A text
    without any term that goes with label 1 is scored by all its words.
    evidence: of the k voters the nearest few, each with a labelled document
    that has that vector, the share of label 1 among all that have it, cosine
    and weight; empty for a document without any word of an example. Other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, remainder, **bounds))

    def score(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                model = sent.value
                out, (text, *voters) = model.score(part.column("text"), k, softness)
                shown = np.flatnonzero(np.arange(len(text)) - np.searchsorted(text, text) < evidence)
                text, columns = text[shown], [pa.array(x[shown]) for x in voters]
                at = pa.array(np.searchsorted(text, np.arange(len(out) + 1)), pa.int32())
                voters = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, names=["doc_id", "toxic", "cosine", "weight"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), voters], names=["doc_id", "score", "predicted", "evidence"])
        tk.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score, f"doc_id {kind}, score double, predicted int, evidence {EVIDENCE}")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, k: int = 16, softness: float = 0.05, modulus: int = 5, remainder: int = 0, **bounds) -> DataFrame:
    """The rows of docs, with all their columns, whose score stays under 0.5; see score_toxicity. No shuffle of docs.

    Null and empty texts, ties and rows that repeat are scored as there; without
    usable labels, and from an empty table, nothing goes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, remainder, **bounds))

    def keep(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield part.filter(pa.array(sent.value.score(part.column("text"), k, softness)[0] < 0.5))
        tk.release()

    return docs.mapInArrow(keep, docs.schema)
