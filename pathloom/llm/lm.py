"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the
preceding bytes, to a depth of five. In every tree a node estimates its bit by
Krichevsky-Trofimov counts, and weighs its own estimate against that of its
children by how well either would have coded the training text. A document's
score is the sum of the log probabilities of its bytes and of its end.

The model isn't sent around whole. Documents are dealt to chunks by hash; a
chunk asks for the byte strings and words that it holds, and gets the log
probability or the count of just these:

    chunk -> (string, chunk, training count)   combined in the task
          -> count by string                   combined before the shuffle
          -> log probability by string         contexts of three bytes together
          -> back to the chunks that asked

Only the nodes of depth 0 to 2 are gathered on the driver: at most
65536 * 255 rows, whatever the corpus.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .session import discard, held_out, n_partitions, stage

DEPTH = 5
GRAM, WORD = 0, 1
END_WORD = np.int64(-1)  # key of the end token


def byte_strings(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each byte and end with its context, index of each document's first): n + 1 a document of n bytes.

    Key: the five bytes before, nearest first, then the byte; before the text
    stand zeros, and the end is a zero.
    """
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    at = np.arange(len(buf)) + np.repeat(np.arange(n_docs) * (DEPTH + 1) + DEPTH, size)
    padded = np.zeros(len(buf) + n_docs * (DEPTH + 1), dtype=np.uint64)
    padded[at] = buf
    key = padded[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        key |= padded[DEPTH - back : len(padded) - back] << np.uint64(8 * (DEPTH + 1 - back))
    first = np.concatenate([[0], np.cumsum(size + 1)])
    use = np.arange(first[-1]) + np.repeat(np.arange(n_docs) * DEPTH, size + 1)
    return key[use].view(np.int64), first


def gram_pieces(buf: np.ndarray, offsets: np.ndarray, target: int):
    """byte_strings of all documents at once, or of a single long one in pieces: (keys, index of each document's first, as far as they are here)."""
    if len(offsets) != 2 or len(buf) <= 4 * target:
        yield byte_strings(buf, offsets)
        return
    for at in range(0, len(buf), target):
        before = min(at, DEPTH)  # bytes that are there as context only
        piece = buf[at - before : at + target]
        key = byte_strings(piece, np.array([0, len(piece)]))[0][before:]
        if at + target < len(buf):
            key = key[:-1]  # no end yet
        yield key, np.array([0, len(key)])


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word and end token, index of each document's first)."""
    h, first = tk.word_hashes(buf, offsets)
    n_docs = len(offsets) - 1
    h = h.view(np.int64)
    at = first + np.arange(n_docs + 1)
    out = np.full(at[-1], END_WORD, dtype=np.int64)
    out[np.arange(len(h)) + np.repeat(np.arange(n_docs), np.diff(first))] = h
    return out, at


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n[:0]


SLICE = 1 << 18  # bytes of text at once


def _asked(batches, most: int = 1 << 22):
    """(kind, key, chunk, n): what each chunk holds; n counts the training text. A chunk of over `most` keys may tell one more than once."""
    held: dict[tuple[int, int], list] = {}

    def out(kind, chunk, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(np.full(len(key), chunk, np.int32)), pa.array(n)], names=["kind", "key", "chunk", "n"])

    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        for chunk in np.unique(chunks):
            own = batch.filter(pa.array(chunks == chunk))
            for part in tk.slices(own, "text", SLICE):
                flat = tk.flat(part.column("text"))
                training = ~part.column("held_out").to_numpy(zero_copy_only=False)
                for kind, (key, first) in chain(((GRAM, x) for x in gram_pieces(*flat, SLICE)), ((WORD, x) for x in (tokens(*flat),))):
                    learn = np.repeat(training, np.diff(first))
                    seen, n = np.unique(key[learn], return_counts=True)
                    rest = np.unique(key[~learn])
                    mine = held.setdefault((kind, int(chunk)), [])
                    mine += [(seen, n.astype(np.int64)), (rest, np.zeros(len(rest), np.int64))]
                    if sum(len(p[0]) for p in mine[1:]) > max(1 << 18, len(mine[0][0])):
                        mine[:] = [_merge(mine)]
                        if len(mine[0][0]) > most:
                            yield out(kind, chunk, *mine.pop())
    for (kind, chunk), mine in held.items():
        if mine:
            key, n = _merge(mine)
            for s in range(0, len(key), 1 << 17):
                yield out(kind, chunk, key[s : s + (1 << 17)], n[s : s + (1 << 17)])
            mine.clear()
    tk.release()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series eight steps up."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the probability that Krichevsky-Trofimov estimation gives to any sequence of a zeros and b ones."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1)


def log_weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2)


def weight(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of the eight decisions of each key's byte, rows x 8."""
    byte = (key & 255)[:, None]
    t = np.arange(8)
    return (1 << t) | (byte >> (8 - t)), (byte >> (7 - t)) & 1


class Lower:
    """The nodes of depth 4 to DEPTH for keys sorted by key; whole contexts of four bytes."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key = key
        self.node, self.bit = _bits(key)
        n8 = np.repeat(n, 8).reshape(-1, 8)
        self.at, self.ones, self.zeros, self.weights = {}, {}, {}, {}
        below = None
        for d in range(DEPTH, 3, -1):
            cell = (_rank(key >> (8 * (DEPTH + 1 - d)))[:, None] * 256 + self.node).ravel()
            cells, where = np.unique(cell, return_inverse=True)
            self.at[d] = where.astype(np.int32)
            self.ones[d] = np.bincount(where, (n8 * self.bit).ravel(), len(cells))
            self.zeros[d] = np.bincount(where, (n8 * (1 - self.bit)).ravel(), len(cells))
            own = log_kt(self.zeros[d], self.ones[d])
            if below is None:
                below, self.weights[d] = own, np.ones(len(cells))
            else:
                # each node below stands in one node here
                parent = np.zeros(len(below), dtype=np.int64)
                parent[self.at[d + 1]] = where
                sums = np.bincount(parent, below, len(cells))
                below, self.weights[d] = log_weighted(own, sums), weight(own, sums)
        self.log_w = below
        self.cell = np.zeros(len(below), dtype=np.int64)  # node of depth 3 above: context of three bytes, node
        self.cell[self.at[4]] = ((key >> 24)[:, None] * 256 + self.node).ravel()

    def sums(self) -> tuple[np.ndarray, ...]:
        """(node of depth 3, zeros, ones, log weighted probability of its children) as far as these keys tell."""
        cells, where = np.unique(self.cell, return_inverse=True)
        return cells, *(np.bincount(where, x, len(cells)) for x in (self.zeros[4], self.ones[4], self.log_w))

    def one(self) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one at depth 4, whether that context was seen), one a key and decision."""
        p, seen = None, None
        for d in range(DEPTH, 3, -1):
            zeros, ones = self.zeros[d][self.at[d]], self.ones[d][self.at[d]]
            kt = (ones + 0.5) / (zeros + ones + 1)
            w = self.weights[d][self.at[d]]
            p = kt if p is None else np.where(seen, w * kt + (1 - w) * p, kt)
            seen = zeros + ones > 0
        return p, seen


def _rank(context: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], context[1:] != context[:-1]])) if len(context) else context


class Levels:
    """The nodes of depth 3 to DEPTH for keys sorted by key; whole contexts of three bytes, worked through in parts of whole contexts of four."""

    def __init__(self, key: np.ndarray, n: np.ndarray, rows: int):
        self.key, self.n = key, n
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] >> 16) != (key[:-1] >> 16)])) if len(key) else np.zeros(0, np.int64)
        self.cuts = [0]
        for edge in [*edges.tolist()[1:], len(key)]:  # at most 65536 keys from edge to edge
            if edge - self.cuts[-1] >= rows or edge == len(key):
                self.cuts.append(edge)
        self.only = Lower(key, n) if len(self.cuts) == 2 else None
        parts = [x.sums() for x in self.parts()]
        cell = np.concatenate([x[0] for x in parts])
        self.cell, where = np.unique(cell, return_inverse=True)
        self.zeros, self.ones, children = (np.bincount(where, np.concatenate([x[i] for x in parts]), len(self.cell)) for i in (1, 2, 3))
        own = log_kt(self.zeros, self.ones)
        self.log_w, self.weights = log_weighted(own, children), weight(own, children)

    def parts(self):
        if self.only is not None:
            yield self.only
            return
        for s, e in zip(self.cuts[:-1], self.cuts[1:]):
            yield Lower(self.key[s:e], self.n[s:e])

    def up(self) -> tuple[np.ndarray, ...]:
        """(context of two bytes, node, zeros, ones, log weighted probability of the children)."""
        cells, where = np.unique((self.cell >> 16 << 8) | (self.cell & 255), return_inverse=True)
        sums = [np.bincount(where, x, len(cells)) for x in (self.zeros, self.ones, self.log_w)]
        return cells >> 8, cells & 255, *sums

    def one(self, part: Lower) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one at depth 3, whether that context was seen), rows x 8."""
        p, seen = part.one()
        at = np.searchsorted(self.cell, ((part.key >> 24)[:, None] * 256 + part.node).ravel())
        zeros, ones, w = self.zeros[at], self.ones[at], self.weights[at]
        kt = (ones + 0.5) / (zeros + ones + 1)
        p = np.where(seen, w * kt + (1 - w) * p, kt)
        return p.reshape(-1, 8), (zeros + ones > 0).reshape(-1, 8)


class Top:
    """The nodes of depth 0 to 2."""

    def __init__(self, context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
        cell = context.astype(np.int64) * 256 + node
        order = np.argsort(cell)
        self.cell, zeros, ones, children = cell[order], zeros[order], ones[order], children[order]
        own = log_kt(zeros, ones)
        w2, kt2, seen2 = weight(own, children), (ones + 0.5) / (zeros + ones + 1), zeros + ones > 0
        below = log_weighted(own, children)
        cell1 = (self.cell >> 16 << 8) | (self.cell & 255)
        add = lambda at, x, n: np.bincount(at, x, n)
        z1, o1, c1 = (add(cell1, x, 65536) for x in (zeros, ones, below))
        own1 = log_kt(z1, o1)
        self.w1, kt1, seen1 = weight(own1, c1), (o1 + 0.5) / (z1 + o1 + 1), z1 + o1 > 0
        below1 = np.where(seen1, log_weighted(own1, c1), 0.0)
        node1 = np.arange(65536) & 255
        z0, o0, c0 = (add(node1, x, 256) for x in (z1, o1, below1))
        own0 = log_kt(z0, o0)
        w0, kt0 = weight(own0, c0)[node1], ((o0 + 0.5) / (z0 + o0 + 1))[node1]
        # probability at the root = base + slope * probability at the depth below
        base0, slope0 = w0 * kt0, 1 - w0
        self.tail0 = kt0[:256]  # the context of one byte wasn't seen
        self.tail1 = np.where(seen1, base0 + slope0 * kt1, kt0)  # that of two bytes wasn't
        base1, slope1 = base0 + slope0 * self.w1 * kt1, slope0 * (1 - self.w1)
        self.tail2 = np.where(seen2, base1[cell1] + slope1[cell1] * kt2, self.tail1[cell1])
        self.base = base1[cell1] + slope1[cell1] * w2 * kt2
        self.slope = slope1[cell1] * (1 - w2)

    def root(self, key: np.ndarray, node: np.ndarray, p: np.ndarray, seen: np.ndarray) -> np.ndarray:
        cell = ((key >> 32)[:, None] * 256 + node).ravel()
        at = np.searchsorted(self.cell, cell)  # every cell of a key is there
        out = np.where(seen.ravel(), self.base[at] + self.slope[at] * p.ravel(), self.tail2[at])
        return out.reshape(p.shape)


def _contexts(batches, solve, rows: int = 1 << 15):
    """Keys sorted; whole contexts of three bytes go to solve, about `rows` keys at once; one context has 2**24 at most."""
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        n = np.concatenate([n, batch.column("n").to_numpy()])
        if len(key) >= rows:
            cut = int(np.searchsorted(key >> 24, key[-1] >> 24))
            if cut:
                yield from solve(key[:cut], n[:cut], rows)
                key, n = key[cut:], n[cut:]
    if len(key):
        yield from solve(key, n, rows)
    tk.release()


def _up(key, n, rows):
    context, node, zeros, ones, log_w = Levels(key, n, rows).up()
    yield pa.RecordBatch.from_arrays([pa.array(context.astype(np.int32)), pa.array(node.astype(np.int16)), pa.array(zeros), pa.array(ones), pa.array(log_w)], names=["context", "node", "zeros", "ones", "log_w"])


def _log_probabilities(key, n, rows, top: Top):
    levels = Levels(key, n, rows)
    for part in levels.parts():
        p = top.root(part.key, part.node, *levels.one(part))
        value = np.log10(np.where(part.bit == 1, p, 1 - p)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(part.key), pa.array(value)], names=["key", "value"])


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of keys that are all there. Each is looked for once, in order: a search at random places costs several times as much."""
    own, which = np.unique(asked, return_inverse=True)
    return values[np.searchsorted(keys, own)][which]


def _score_chunk(docs: pa.Table, known: pa.Table, n_train: int, n_types: int) -> pa.Table:
    kind, key, value = (known.column(c).to_numpy() for c in ("kind", "key", "value"))
    tables = {}
    for k in (GRAM, WORD):
        own, at = np.unique(key[kind == k], return_index=True)
        tables[k] = own, value[kind == k][at]
    out = []
    for batch in docs.combine_chunks().to_batches():
        for part in tk.slices(batch, "text", SLICE):
            flat = tk.flat(part.column("text"))
            score = np.zeros(part.num_rows)
            for key, first in gram_pieces(*flat, SLICE):
                score += np.add.reduceat(_look_up(*tables[GRAM], key), first[:-1])
            key, first = tokens(*flat)
            count = _look_up(*tables[WORD], key)
            base = np.add.reduceat(np.log10((count + 0.5) / (n_train + 0.5 * (n_types + 1))), first[:-1])
            known_ = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
            n = part.num_rows
            cols = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), pa.array(known_), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(score), pa.array(np.diff(flat[1]))]
            out.append(pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]))
    tk.release()
    return pa.Table.from_batches(out) if out else pa.table({})


def score_documents(docs: DataFrame, modulus: int = 5, remainder: int = 1, chunk_bytes: int = 16 << 20, least_chunks: int = 32) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: one row for each row of docs.

    Learns from the rows whose crc32(doc_id as text) doesn't leave `remainder`
    (null ids learn). score: log10 probability of the bytes of the text and its
    end; bits_per_byte: the code length, -score / log10(2) / n_bytes (null for
    an empty text). A zero byte within a text counts as an end there. base_score:
    the unigram model over lower-cased words and the end token, with half a
    count added. Null texts are empty: one token, the end. Rows that repeat
    count and are scored each. Without training rows every bit has probability
    1/2. Other columns are left out.
    """
    spark = docs.sparkSession
    parts = n_partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(least_chunks, -(-total // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)).cast("int"))
    asked = stage(rows.repartition(max(parts, chunks), "chunk").mapInArrow(_asked, "kind int, key long, chunk int, n long"), "lm-asked")
    counts = stage(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n").repartition(parts, F.shiftrightunsigned("key", 24)).sortWithinPartitions("key")
    upper = grams.mapInArrow(lambda it: _contexts(it, _up), "context int, node short, zeros double, ones double, log_w double")
    upper = upper.groupBy("context", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("log_w")).toArrow()
    top = Top(*(upper.column(c).to_numpy() for c in ("context", "node", "zeros", "ones", "log_w")))
    del upper
    sent = spark.sparkContext.broadcast(top)
    scored = grams.mapInArrow(lambda it: _contexts(it, lambda key, n, rows: _log_probabilities(key, n, rows, sent.value)), "key long, value double")
    words = counts.filter(F.col("kind") == WORD)
    n_train, n_types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    values = scored.select(F.lit(GRAM).alias("kind"), "key", "value").unionByName(words.select("kind", "key", F.col("n").cast("double").alias("value")))
    answers = asked.select("kind", "key", "chunk").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    answers = stage(answers, "lm-answers")
    discard(asked, counts)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: _score_chunk(a, b, n_train, n_types), schema)
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") / np.log10(2.0) / F.col("n_bytes")))
