"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

The benchmark is a stated query set: it is taken in blocks of bounded text, and
each block meets all documents in two scans. The first counts how often each
item's pairs of neighbouring words (seeds) occur in the corpus. The second
meets passages by an item's rarest seeds and scores the passage around each by
local alignment over words, so that edited and paraphrased copies still count.
Documents are never shuffled.

Seeds lose nothing. A score of t takes m matched words and at most m - t breaks
between them, so at least t - 1 pairs of neighbours are whole. An item of n
words has n - 1 pairs: one of its n - t + 1 rarest is always there, however
often each occurs. Counts choose which seeds are looked up, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

# Letters, digits and non-ASCII bytes make words; case doesn't count.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
for _a, _b in ((48, 58), (97, 123)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tk.flat(texts)
    return tk.word_hashes(_PLAIN[raw], offsets)


def _seeds(words: np.ndarray, first: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, place of its first word) of each pair of neighbouring words, then, if single, of each word; and the number of pairs."""
    pairs = np.ones(len(words), dtype=bool)
    pairs[first[1:][np.diff(first) > 0] - 1] = False
    pairs = np.flatnonzero(pairs)
    h, _ = tk.shingles(words, first, 2, short=False)
    if not single:
        return h, pairs, len(pairs)
    return np.concatenate([h, words]), np.concatenate([pairs, np.arange(len(words))]), len(pairs)


class Items:
    """A block of benchmark items with its seeds."""

    def __init__(self, ids: list, texts: list, share: float, least: int):
        self.ids = ids
        self.words, self.first = _words(pa.array(texts, pa.large_string()))
        self.length = np.diff(self.first)
        # The lowest score that counts; scores are whole numbers.
        self.need = np.maximum(np.ceil(np.maximum(share * self.length, np.minimum(least, self.length)) - 1e-9), 1).astype(np.int64)
        self.room = np.maximum(self.length - self.need, 0)  # gaps that leave that score
        h, word, n_pairs = _seeds(self.words, self.first, True)
        item = np.searchsorted(self.first, word, side="right") - 1
        # A score of 1 needs no whole pair: single words are the seeds.
        use = (np.arange(len(h)) >= n_pairs) == (self.need[item] == 1)
        self.item, self.place = item[use], (word - self.first[item])[use]
        self.single = bool((self.need[item] == 1).any())
        self.seeds, self.seed = np.unique(h[use], return_inverse=True)
        self.pairs = np.unique(self.item * len(self.seeds) + self.seed)
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self.seeds >> np.uint64(44)] = True
        self.keep_rare(np.zeros(len(self.seeds), dtype=np.int64))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, seed) of those that are seeds."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[h >> np.uint64(44)])
        seed = np.minimum(np.searchsorted(self.seeds, h[maybe]), len(self.seeds) - 1)
        same = self.seeds[seed] == h[maybe]
        return maybe[same], seed[same]

    def keep_rare(self, counts: np.ndarray) -> None:
        """Look passages up by each item's rarest seeds, as many as one must be there of."""
        order = np.lexsort((self.place, counts[self.seed], self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank <= self.room[item]]
        order = order[np.lexsort((self.place[order], self.item[order], self.seed[order]))]
        self.anchors = self.item[order], self.place[order]
        self.at = np.searchsorted(self.seed[order], np.arange(len(self.seeds) + 1))


def align(item_words: np.ndarray, lengths: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """The score alone; see align_to."""
    return align_to(item_words, lengths, passages)[0]


def align_to(item_words: np.ndarray, lengths: np.ndarray, passages: np.ndarray, match: float = 1.0, miss: float = -1.0, gap: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman score, end) of each row: words of an item against words of a passage, both padded with 0 (never equal); the first end in the passage at which the score is reached."""
    rows, width = passages.shape
    ramp = gap * np.arange(width + 1)
    above, best, end = np.zeros((rows, width + 1)), np.zeros(rows), np.zeros(rows, dtype=np.int64)
    for i in range(item_words.shape[1]):
        equal = (passages == item_words[:, i : i + 1]) & (passages != 0)
        now = np.zeros((rows, width + 1))
        now[:, 1:] = np.maximum(0.0, np.maximum(above[:, :-1] + np.where(equal, match, miss), above[:, 1:] + gap))
        now = np.maximum.accumulate(now - ramp, axis=1) + ramp  # gaps along the passage
        now[i >= lengths] = 0.0
        at = now.argmax(axis=1)
        top = now[np.arange(rows), at]
        better = (top > best) | ((top == best) & (top > 0) & (at < end))
        best, end = np.where(better, top, best), np.where(better, at, end)
        above = now
    return best, end


def _enough(items: Items, seed_of: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each window holds as many of its item's word pairs as the lowest score takes."""
    held = np.flatnonzero(seed_of >= 0)
    s, e = np.searchsorted(held, lo), np.searchsorted(held, hi - 1)
    out = items.need[item] <= 1
    n = np.maximum(e - s, 0)
    part = np.cumsum(n) >> 20  # so many at a time
    for mine in np.split(np.arange(len(item)), np.flatnonzero(np.diff(part)) + 1):
        each = np.repeat(mine, n[mine])
        inner = np.arange(len(each)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
        asked = item[each] * len(items.seeds) + seed_of[held[s[each] + inner]]
        use = np.minimum(np.searchsorted(items.pairs, asked), len(items.pairs) - 1)
        got = np.bincount(each[items.pairs[use] == asked] - mine[0], minlength=len(mine)) if len(each) else 0
        out[mine] |= got >= items.need[item[mine]] - 1
    return out


def _passages(items: Items, words: np.ndarray, first: np.ndarray):
    """Windows to align: (document, item, first word, end), one for each group of near diagonals."""
    h, word, n_pairs = _seeds(words, first, items.single)
    pos, seed = items.hits(h)
    seed_of = np.full(len(words), -1)
    seed_of[word[pos[pos < n_pairs]]] = seed[pos < n_pairs]
    n_items = np.diff(items.at)[seed] if len(seed) else seed
    pos, seed = np.repeat(pos, n_items), np.repeat(seed, n_items)
    inner = np.arange(len(seed)) - np.repeat(np.cumsum(n_items) - n_items, n_items)
    use = items.at[seed] + inner
    item, place = items.anchors[0][use], items.anchors[1][use]
    word = word[pos]
    doc = np.searchsorted(first, word, side="right") - 1
    diagonal = word - place
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    if not len(doc):
        return doc, item, diagonal, diagonal
    room = items.room[item]
    cell = (diagonal - first[doc]) // (room + 1)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(doc)) - 1
    doc, item, lo, hi, room = doc[s], item[s], diagonal[s], diagonal[e], room[s]
    lo = np.maximum(lo - room, first[doc])
    hi = np.minimum(hi + items.length[item] + room, first[doc + 1])
    good = _enough(items, seed_of, item, lo, hi)
    return doc[good], item[good], lo[good], hi[good]


def _aligned(words: np.ndarray, items: Items, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(score, end) of items against words lo to hi; back: both read from behind, so that the end is counted from hi."""
    score, end, length = np.zeros(len(item)), np.zeros(len(item), dtype=np.int64), items.length
    order = np.argsort(np.maximum(hi - lo, length[item]), kind="stable")
    padded = np.append(words, np.zeros(1, np.uint64))
    own = np.append(items.words, np.zeros(1, np.uint64))
    step = max(1, min(256, (1 << 20) // max(1, (hi - lo).max(initial=0))))
    for s in range(0, len(order), step):
        mine = order[s : s + step]
        cols = np.arange((hi - lo)[mine].max())
        at = hi[mine, None] - 1 - cols if back else lo[mine, None] + cols
        passages = padded[np.where((at >= lo[mine, None]) & (at < hi[mine, None]), at, len(words))]
        cols, n = np.arange(length[item[mine]].max()), length[item[mine], None]
        at = items.first[item[mine], None] + (n - 1 - cols if back else cols)
        asked = own[np.where(cols < n, at, len(items.words))]
        score[mine], end[mine] = align_to(asked, length[item[mine]], passages)
    return score, end


def _found(texts, items: Items) -> tuple[np.ndarray, ...]:
    """(document, item, score, from word, to word) of the best passage of each document and item that is found."""
    length = items.length
    words, first = _words(texts)
    doc, item, lo, hi = _passages(items, words, first)
    score, end = _aligned(words, items, item, lo, hi)
    good = np.flatnonzero(score >= items.need[item])
    order = good[np.lexsort((lo[good], -score[good], item[good], doc[good]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
    top = order[new]
    doc, item, lo, score = doc[top], item[top], lo[top], score[top]
    hi = lo + end[top]
    # No passage that ends earlier has this score, so what is aligned from behind begins at hi; its end is where the alignment begins.
    _, back = _aligned(words, items, item, lo, hi, back=True)
    return doc, item, score / length[item], hi - back - first[doc], hi - first[doc]


def _blocks(docs: DataFrame, benchmark: DataFrame, share: float, least: int, block_bytes: int):
    """The benchmark in blocks, each with its rarest seeds as counted over all of docs."""
    own = docs.select("text").filter("text is not null")
    asked = benchmark.select("item_id", "text").filter("text is not null")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).toArrow()
        block = block.sort_by([("item_id", "ascending"), ("text", "ascending")])
        items = Items(block.column("item_id").to_pylist(), block.column("text").to_pylist(), share, least)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def count(batches, sent=sent):
            items = sent.value
            total = np.zeros(len(items.seeds), dtype=np.int64)
            for batch in batches:
                for part in tk.slices(batch, "text"):
                    words, first = _words(part.column("text"))
                    _, seed = items.hits(_seeds(words, first, items.single)[0])
                    total += np.bincount(seed, minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["seed", "n"])

        counts = np.zeros(len(items.seeds), dtype=np.int64)
        if len(counts):
            seen = own.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
            counts[seen.column("seed").to_numpy()] = seen.column("n").to_numpy()
        items.keep_rare(counts)
        yield items, docs.sparkSession.sparkContext.broadcast(items)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = 0.5,
    least: int = 8,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id, item_id, score, from_word, to_word: one row for each document and item found in it.

    score: alignment score over the item's number of words (1: a verbatim copy;
    a replaced, missing or additional word costs up to 2, 1 or 1 words). At
    least `share` of the item and `least` words (or the whole of a shorter item)
    must align. from_word, to_word: the words of the document that were
    aligned, counted from 0, to_word not included; of several such passages the
    one that ends first, as short as it can be. Items without words, null texts and empty tables
    give no row. Every document and item that score so much are found. Rows that repeat, in either table, are found each.
    Other columns are left out.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text").filter("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for items, sent in _blocks(docs, benchmark, share, least, block_bytes):

        def scan(batches, sent=sent):
            for batch in batches:
                for part in tk.slices(batch, "text"):
                    doc, *rest = _found(part.column("text"), sent.value)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), *map(pa.array, rest)], names=["doc_id", "item", "score", "from_word", "to_word"])

        got = own.mapInArrow(scan, f"doc_id {kind}, item long, score double, from_word long, to_word long")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], f"item long, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        got = got.join(F.broadcast(names), "item").select("doc_id", "item_id", "score", "from_word", "to_word")  # at most block_bytes of items
        found = got if found is None else found.unionByName(got)
    return found


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = 0.5,
    least: int = 8,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item is found; see contaminated. No shuffle of docs."""
    out = docs
    for _, sent in _blocks(docs, benchmark, share, least, block_bytes):

        def keep(batches, sent=sent):
            for batch in batches:
                for part in tk.slices(batch, "text"):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[_found(part.column("text"), sent.value)[0]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
