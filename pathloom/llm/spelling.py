"""Spelling variant grouping by two-dimensional range reporting.

1. Runs of letters are counted over all documents; some lose a letter by a rule
   on (document, run), which stands for typing errors.
2. Two words of lengths L and L, or L and L - 1, that are one edit apart agree
   outside one place p of the longer one. For each L the places are cut into
   ranges, halves at first, and words that agree outside a range form a group; a
   group of too many words is cut into the halves of its range, down to single
   places, where a group is bounded by the alphabet.
3. In a group the words of length L are points: their rank in forward order, and
   in the order of the reversed words. For each place of a word the prefix before it
   is an interval of forward ranks and the suffix after it one of reverse
   ranks; a wavelet tree reports the points in both. Of an insertion into a run of
   equal letters only the first place counts, so each pair is found once.
4. Roots follow forms by pointer doubling; a form is at least twice as frequent,
   so the doublings are few.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetokens as bt
from . import textkit as tk
from .session import discard, n_partitions, stage

SHORT = 64  # bytes up to which a word's checksum is combined from those of its parts
_CUT = ~bt.IS_TERM  # where a long text may be cut: before what is no letter and begins a code point
_CUT[0xC2] = _CUT[0xC4:0xF5] = True


def _zero_byte_steps() -> np.ndarray:
    """What a zero byte does to a CRC-32 register, by its low byte (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_STEPS = _zero_byte_steps()


def checksums(prefixes: list[bytes], doc: np.ndarray, words: list[bytes], word: np.ndarray) -> np.ndarray:
    """crc32(prefixes[doc[i]] + words[word[i]]) of each i: the prefix's checksum, advanced by the word's length, xor the word's."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    own = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    most = int(min(size.max(initial=0), SHORT))
    ahead = np.empty((most + 1, len(prefixes)), dtype=np.uint32)
    ahead[0] = [zlib.crc32(p) for p in prefixes]
    for k in range(most):
        ahead[k + 1] = _STEPS[ahead[k] & np.uint32(255)] ^ (ahead[k] >> np.uint32(8))
    out = ahead[np.minimum(size[word], most), doc] ^ own[word]
    for i in np.flatnonzero(size[word] > most).tolist():
        out[i] = zlib.crc32(words[word[i]], int(ahead[0, doc[i]]))
    return out


def _count(batches, modulus: int, least: int, target: int = 1 << 21):
    for batch in batches:
        for part in tk.slices(batch, "text", target):
            ids = part.column("id").to_pylist()
            for at, piece, offsets in tk.word_pieces(*tk.flat(part.column("text")), target, _CUT):
                low = tk.lower(piece)
                start, end, first = bt.spans(bt.latin_letters(low), offsets)
                if not len(start):
                    continue
                word, rep = bt.group(low, start, end)
                words = [low[s:e].tobytes() for s, e in zip(start[rep], end[rep])]
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                h = checksums([f"{x}:".encode() for x in ids[at : at + len(first) - 1]], doc, words, word)
                struck = h % np.uint32(modulus) == 0
                n = np.bincount(word[~struck], minlength=len(words))
                whole = [w.decode() for w in words]
                total = Counter({w: k for w, k in zip(whole, n.tolist()) if k})
                for w, x in zip(word[struck].tolist(), h[struck].tolist()):
                    k = x % len(whole[w])
                    total[whole[w][:k] + whole[w][k + 1 :]] += 1
                kept = [(w, k) for w, k in total.items() if len(w) >= least]
                if kept:
                    w, k = zip(*kept)
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64())], names=["word", "n"])
    tk.release()


class WaveletTree:
    """A permutation of 0 to n - 1, level by level: at each, the values with a 0 in the level's bit stand before those with a 1."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.ones: list[np.ndarray] = []  # of each level, how many ones stand before a place
        self.bits = max(1, (self.n - 1).bit_length())
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [y0, y1) at places in [x0, x1), for many queries at once."""
        query, value = np.arange(len(x0)), np.zeros(len(x0), dtype=np.int64)
        for b, ones in zip(reversed(range(self.bits)), self.ones):
            before, upto, zeros = ones[x0], ones[x1], self.n - ones[-1]
            query, value = np.concatenate([query, query]), np.concatenate([value, value | (1 << b)])
            x0, x1 = np.concatenate([x0 - before, zeros + before]), np.concatenate([x1 - upto, zeros + upto])
            keep = (x0 < x1) & (value < y1[query]) & (value + (1 << b) > y0[query])
            query, value, x0, x1 = query[keep], value[keep], x0[keep], x1[keep]
        return query, value


def _intervals(shared: np.ndarray, rank: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of the ranks around rank[i] that share length[i] letters; shared[r]: what ranks r - 1 and r share, less than 0 at both ends."""
    lo, hi = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
    place = np.arange(len(shared))
    for k in np.unique(length):
        at, edge = np.flatnonzero(length == k), shared < k
        lo[at] = np.maximum.accumulate(np.where(edge, place, 0))[rank[at]]
        hi[at] = np.minimum.accumulate(np.where(edge, place, len(shared))[::-1])[::-1][rank[at] + 1]
    return lo, hi


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared) of byte rows that begin with four bytes of their group: as in _intervals, -1 between groups."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    shared = np.full(len(rows) + 1, -1, dtype=np.int64)
    for s in range(1, len(rows), 4096):
        unlike = rows[order[s : s + 4096]] != rows[order[s - 1 : s - 1 + len(order[s : s + 4096])]]
        shared[s : s + 4096][: len(unlike)] = np.maximum(unlike.argmax(axis=1) - 4, -1)
    return order, shared


def near_pairs(group: np.ndarray, words: list[bytes], size: np.ndarray, lo: np.ndarray, hi: np.ndarray, at_once: int = 1 << 16):
    """Yields (a, b): rows that are one edit apart, once in each direction.

    Rows of a group have the same size (L), lo and hi; words have L or L - 1 letters, one byte each, and are distinct in a group.
    """
    n, length = len(words), np.array([len(w) for w in words], dtype=np.int64)
    forward = np.zeros((n, 4 + int(length.max())), dtype=np.uint8)
    forward[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
    backward = forward.copy()
    row = np.repeat(np.arange(n), length)
    letter = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    every = np.frombuffer(b"".join(words), dtype=np.uint8)
    forward[row, 4 + letter] = every
    backward[row, 3 + length[row] - letter] = every

    point = length == size
    (forder, fshared), (border, bshared) = _ordered(forward), _ordered(backward)
    frank, brank = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    frank[forder], brank[border] = np.arange(n), np.arange(n)
    fpoints, bpoints = (np.concatenate([[0], np.cumsum(point[o])]) for o in (forder, border))
    if not point.any():
        return
    points = border[point[border]]
    tree = WaveletTree(bpoints[brank[forder[point[forder]]]])

    # Only places where others share the prefix and others share the suffix.
    most = lambda shared, rank: np.maximum(shared[rank], shared[rank + 1])
    begin, end = np.maximum(lo, size - 1 - most(bshared, brank)), np.minimum(hi, most(fshared, frank) + 1)
    asked = np.maximum(end - begin, 0)
    upto, at = np.cumsum(asked), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, side="right")))
        word = np.repeat(np.arange(at, stop), asked[at:stop])
        place = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(asked[at:stop]) - asked[at:stop], asked[at:stop])
        at = stop
        if not len(word):
            continue
        x0, x1 = _intervals(fshared, frank[word], place)
        y0, y1 = _intervals(bshared, brank[word], size[word] - 1 - place)
        query, value = tree.report(fpoints[x0], fpoints[x1], bpoints[y0], bpoints[y1])
        a, b, place = word[query], points[value], place[query]
        replaced = point[a] & (a != b)
        inserted = ~point[a] & ((place == 0) | (forward[b, 4 + place] != forward[b, 3 + place]))
        yield np.concatenate([a[replaced | inserted], b[inserted]]), np.concatenate([b[replaced | inserted], a[inserted]])


def _report(batches, rows_at_once: int = 1 << 13, bytes_at_once: int = 1 << 24):
    """Rows sorted by group (size, lo, hi, key), with word and n: for each word that has near ones in its group, their number and the best."""
    names = ["size", "lo", "hi", "key", "word", "n"]

    def solve(rows: pa.Table):
        size, lo, hi, key, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "lo", "hi", "key", "n"))
        group = np.concatenate([[0], np.cumsum((np.diff(size) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(key) != 0))])
        text = rows.column("word").to_pylist()
        starts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        s = 0
        while s < len(starts) - 1:
            e = s + 1
            while e < len(starts) - 1 and (starts[e + 1] - starts[s]) * (size[starts[e]] + 4) <= bytes_at_once:
                e += 1
            at, to = starts[s], starts[e]
            s = e
            if to - at < 2:
                continue
            words = [w.encode("latin-1") for w in text[at:to]]
            found = list(near_pairs(group[at:to] - group[at], words, size[at:to], lo[at:to], hi[at:to]))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found))
            order = np.array(sorted(range(len(words)), key=words.__getitem__))
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            best = np.lexsort((rank[b], -n[at:to][b], a))
            a, b = a[best], b[best]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            near = np.diff(np.append(first, len(a)))
            a, b = a[first] + at, b[first] + at
            take = lambda i: pa.array([text[k] for k in i.tolist()], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take(a), pa.array(near), pa.array(n[b]), take(b)], names=["word", "n_near", "best_n", "best"])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch.select(names)])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows < rows_at_once:
            continue
        last = np.ones(held.num_rows, dtype=bool)
        for c in names[:4]:
            col = held.column(c).to_numpy()
            last &= col == col[-1]
        cut = held.num_rows - int(last.sum())  # the last group may go on
        if cut:
            yield from solve(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield from solve(held)
    tk.release()


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, size, lo, hi) with key: what the word has outside the range."""
    rest = F.col("hi") + F.when(F.length("word") == F.col("size"), 1).otherwise(0)
    outside = F.concat(F.expr("substring(word, 1, lo)"), F.lit("\0"), F.col("word").substr(rest, F.length("word")))
    return rows.withColumn("key", F.xxhash64(outside))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return _keyed(rows.withColumn("range", F.explode(both)).select("word", "n", "size", "range.lo", "range.hi"))


def _near(words: DataFrame, most: int) -> DataFrame:
    """Staged (word, n_near, best_n, best) of the words that have near ones. words: (word, n)."""
    group = ["size", "lo", "hi", "key"]
    sizes = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    rows = stage(_halves(sizes.select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))), "edit-groups")
    done = []
    while True:
        # At most rows / most of them; joined by Spark's own size check.
        large = stage(rows.groupBy(*group).agg(F.count("*").alias("rows")).filter((F.col("rows") > most) & (F.col("hi") - F.col("lo") > 1)).select(*group), "large-groups")
        if not large.limit(1).count():
            discard(large)
            break
        finer = stage(_halves(rows.join(large, group, "left_semi")), "edit-groups")
        small = stage(rows.join(large, group, "left_anti"), "edit-groups")
        discard(rows, large)
        done.append(small)
        rows = finer
    every = rows
    for more in done:
        every = every.unionByName(more)
    every = every.select(*group, "word", "n").repartition(n_partitions(words.sparkSession), *group).sortWithinPartitions(*group)
    found = every.mapInArrow(_report, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    near = stage(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")), "near-words")
    discard(rows, *done)
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """Staged (word, root): the last word that forms lead to. forms: (word, form), each word once."""
    to = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("via"), F.col("root").alias("further"))
        after = stage(to.join(further, to["root"] == further["via"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(to)
        to = after
        if not to.filter("moved").limit(1).count():
            return to


def spelling_variants(docs: DataFrame, modulus: int = 97, least_length: int = 5, least_n: int = 3, ratio: int = 2, most: int = 1024) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each distinct word.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z
    lower-cased, after the deletion rule: h = crc32("<doc_id>:<run>"); where
    `modulus` divides h, the run's code point h % length goes. Kept: those of
    at least `least_length` code points that occur at least `least_n` times.
    form: the near word (one code point inserted, deleted or replaced) of largest
    n, ties to the smallest in code-point order, if its n is at least `ratio`
    times the word's, else null; root: the last word that forms lead to. The
    relation needn't be an equivalence: variants with the same root are a group.
    Null texts have no words; a null doc_id counts as the empty text; rows
    that repeat count each; other columns aren't read. An empty table gives an
    empty result. most: the words of a group that one task compares; it doesn't
    change the result.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(lambda it: _count(it, modulus, least_length), "word string, n long")
    words = stage(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "words")
    near = _near(words, most)
    large = F.col("best_n") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select("word", F.when(large, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best_n")).alias("form_n"))
    known = stage(known, "forms")
    discard(words, near)
    roots = _roots(known.filter("form is not null"))
    return known.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
