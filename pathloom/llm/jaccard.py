"""N-gram Jaccard join with Bayesian candidate pruning.

1. A node is a distinct text (128-bit hash). Each gets the MinHash signature of
   its word shingles; bands of it give buckets.
2. Nodes that share a bucket are compared there on their signatures, some
   values at a time; a pair is dropped when the posterior probability that its
   similarity reaches the threshold falls below the tolerance. Of the pairs that
   stay only a spanning forest leaves the bucket. Buckets with the same nodes
   are compared once. A bucket too large for that is compared block by block; only
   where its nodes are in several large buckets, as near copies are, they are
   all linked to its smallest one as they stand. So candidate components hold texts
   that are likely similar, not those that merely met in a bucket.
3. Inside a component all pairs are compared, tile by tile: a component of more
   nodes than a tile is split, and each pair of tiles is a group of its own.
   Pairs are pruned as in 2.; the rest are verified on the shingles themselves.
4. A tile pair gives link counts and a spanning forest of its links, never the
   pairs. The forests' components are the classes.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .session import discard, fresh, n_partitions, stage, view

ROWS, BANDS, STEP = 4, 28, 16
SPREAD = 16
FAMILY = 4  # large buckets that the nodes of one are in on average, from which they are taken for near copies
SENT = np.uint16  # the bits of a MinHash value that are sent: values that differ seem equal once in 65536, and such a pair is only compared further
_SEED = np.random.default_rng(20240229)
_MULT = _SEED.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SEED.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (documents x hashes, uint32); all ones for documents without shingles."""
    n = len(at) - 1
    out = np.full((n, len(_MULT)), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts = at[:-1][full]
        for i, (a, b) in enumerate(zip(_MULT, _PLUS)):
            out[full, i] = np.minimum.reduceat(((hashes * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket a band."""
    sig = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.zeros(sig.shape[:2], dtype=np.uint64)
    for r in range(ROWS):
        acc = tk.mix64(acc + sig[:, :, r] + np.uint64(r + 1))
    return tk.mix64(acc + np.arange(BANDS, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float, total: int, step: int = STEP) -> dict[int, int]:
    """After n compared values: the fewest matches at which P(similarity >= threshold) is at least the tolerance.

    With a uniform prior the posterior of m matches in n is Beta(m + 1, n - m + 1),
    whose upper tail is a binomial sum.
    """
    out = {}
    for n in range(step, total + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _verify(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, share: Fraction) -> np.ndarray:
    """Which pairs (a[i], b[i]) reach the share, exactly."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(used) or len(used) < 24:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    else:
        place = np.zeros(len(sets), dtype=np.int64)
        place[used] = np.arange(len(used))
        values, col, n = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), size[used])
        shared = n[col] > 1
        row, col = row[shared], (np.cumsum(n > 1) - 1)[col[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        cross = np.zeros((len(used), len(used)), dtype=np.float32)
        width = 4096
        for s in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            lo, hi = np.searchsorted(col, [s, s + width])
            dense = np.zeros((len(used), width), dtype=np.float32)
            dense[row[lo:hi], col[lo:hi] - s] = 1
            cross += dense @ dense.T
        common = np.rint(cross[place[a], place[b]]).astype(np.int64)
    both = size[a] + size[b] - common
    return common * share.denominator >= both * share.numerator


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of 0 to n - 1 under the links (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
    while (label != label[label]).any():
        label = label[label]
    return label


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, floors: dict) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[i], b[i]) of signatures that Bayesian pruning leaves."""
    matches, done = np.zeros(len(a), dtype=np.int64), 0
    for upto, floor in floors.items():
        matches += (sig[a, done:upto] == sig[b, done:upto]).sum(axis=1)
        keep = matches >= floor
        a, b, matches, done = a[keep], b[keep], matches[keep], upto
    return a, b


def link_group(nodes: np.ndarray, weights: np.ndarray, tiles: np.ndarray, pair: tuple[int, int], sets: list, sig: np.ndarray, share: Fraction, floors: dict) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each node from the pairs of one group: all pairs of a tile with itself, else those across the two tiles."""
    n = len(nodes)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    same = pair[0] == pair[1]
    left, right = (np.flatnonzero(tiles == t) for t in pair)  # either may be empty
    for s in range(0, len(left), 256):
        a, b = np.repeat(left[s : s + 256], len(right)), np.tile(right, len(left[s : s + 256]))
        if same:
            a, b = a[a < b], b[a < b]
        a, b = survivors(sig, a, b, floors)
        if not len(a):
            continue
        good = _verify(sets, a, b, share)
        a, b = a[good], b[good]
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        joined = np.flatnonzero(root != np.arange(n))
        root = forest(n, np.concatenate([a, joined]), np.concatenate([b, root[joined]]))
    return links, nodes[root]


def _signatures_of(column: pa.Array) -> np.ndarray:
    raw, offsets = tk.flat(column)
    return np.frombuffer(raw.tobytes(), dtype=SENT).reshape(len(offsets) - 1, -1)


def _refine(batches, floors: dict, at_once: int = 1 << 18):
    """Rows sorted by bucket (bucket, node, sig): for each bucket a forest (a, b) of the pairs that may be similar."""

    def solve(bucket: np.ndarray, node: np.ndarray, sig: np.ndarray):
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(start, len(bucket)))
        # row i is compared with the rows after it in its bucket
        later = np.repeat(start + size, size) - np.arange(len(bucket)) - 1
        ends, at = np.cumsum(later), 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        while at < len(bucket):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, side="right")))
            a = np.repeat(np.arange(at, stop), later[at:stop])
            b = np.arange(len(a)) - np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop]) + a + 1
            kept.append(survivors(sig, a, b, floors))
            at = stop
        root = forest(len(bucket), *(np.concatenate(x) for x in zip(*kept)))
        edge = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[edge]), pa.array(node[root[edge]])], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        bucket, node = (batch.column(c).to_numpy() for c in ("bucket", "node"))
        held.append((bucket, node, _signatures_of(batch.column("sig"))))
        if sum(len(h[0]) for h in held) < 8192:
            continue
        bucket, node, sig = (np.concatenate(x) for x in zip(*held))
        cut = int(np.flatnonzero(bucket == bucket[-1])[0])  # the last bucket may go on
        if cut:
            yield solve(bucket[:cut], node[:cut], sig[:cut])
        held = [(bucket[cut:], node[cut:], sig[cut:])]
    if held and sum(len(h[0]) for h in held):
        yield solve(*(np.concatenate(x) for x in zip(*held)))
    tk.release()


SETS = "comp long, n_tiles int, tile int, node long, weight long, sig binary, shingles binary"


def _sets(batches, n: int):
    """The distinct shingles of each text, in order, in place of the text: a text is hashed once, however many tiles it goes to."""
    for batch in batches:
        for part in tk.slices(batch, "text"):
            h, at = tk.shingles(*tk.word_hashes(*tk.flat(part.column("text"))), n)
            sets = [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:])]
            upto = np.concatenate([[0], np.cumsum([8 * len(x) for x in sets])]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(upto), pa.py_buffer(np.concatenate([*sets, np.zeros(0, np.uint64)]))])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("comp", "n_tiles", "tile", "node", "weight", "sig")), packed], names=["comp", "n_tiles", "tile", "node", "weight", "sig", "shingles"])
    tk.release()


def _compare(batches, share: Fraction, floors: dict):
    """Rows sorted by group (comp, i, j), nodes ascending; a group may go on in the next batch."""
    held: list[tuple] = []
    key_held = None

    def close():
        nodes = np.array([h[0] for h in held], dtype=np.int64)
        links, root = link_group(nodes, np.array([h[1] for h in held], dtype=np.int64), np.array([h[2] for h in held]), key_held[1:], [h[3] for h in held], np.array([h[4] for h in held]), share, floors)
        return nodes, links, root

    out: list[tuple] = []
    for batch in batches:
        for part in tk.slices(batch, "shingles"):
            raw, at = tk.flat(part.column("shingles"))
            sig = _signatures_of(part.column("sig"))
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "i", "j", "node", "weight", "tile")]
            for r, (comp, i, j, node, weight, tile) in enumerate(zip(*cols)):
                if key_held != (comp, i, j):
                    if held:
                        out.append(close())
                    held, key_held = [], (comp, i, j)
                if held and held[-1][0] == node:
                    continue  # a row that repeats
                held.append((node, weight, tile, np.frombuffer(raw[at[r] : at[r + 1]].tobytes(), dtype=np.uint64), sig[r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["node", "links", "root"])
                out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in close()], names=["node", "links", "root"])
    held.clear()
    tk.release()


def _text_id(text="text") -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _candidates(nodes: DataFrame, floors: dict, most: int) -> DataFrame:
    """(node, comp): nodes that may be similar to another one, by component."""
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    held = placed.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("other"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"))
    # Of buckets with the same nodes one is enough.
    held = stage(held.filter("n > 1").groupBy("n", "head", "other", "all").agg(F.min("bucket").alias("bucket")).select("bucket", "head", "n"), "buckets")
    crowd = stage(placed.join(held.filter(F.col("n") > most).hint("merge"), "bucket").select("node", F.col("bucket").alias("crowd"), "head", "n"), "large-buckets")
    # Near copies meet in many large buckets, others in one or two: a bucket of such nodes is a candidate group as it stands.
    meets = crowd.groupBy("node").agg(F.count("*").alias("meets"))
    shared = stage(crowd.join(meets, "node").groupBy("crowd").agg((F.avg("meets") >= FAMILY).alias("family")), "families")
    # Nodes of another large bucket are compared, too: in blocks of it, each with each.
    blocks = F.ceil(F.col("n") / most).cast("int")
    apart = crowd.join(shared.filter("not family"), "crowd").select("node", "crowd", F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    apart = apart.select(F.xxhash64("crowd", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node")
    met = placed.join(held.filter(F.col("n") <= most).select("bucket").hint("merge"), "bucket").select("bucket", "node").unionByName(apart).join(nodes.select("node", "sig"), "node")
    met = met.select("bucket", "node", "sig").repartition(n_partitions(nodes.sparkSession), F.xxhash64("bucket")).sortWithinPartitions("bucket")
    edges = met.mapInArrow(lambda it: _refine(it, floors), "a long, b long")
    # A node goes to the smallest of its heads, and its other heads go there too: a family has few heads.
    headed = crowd.join(shared.filter("family"), "crowd").groupBy("node").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    to = F.col("heads")[0].alias("b")
    star = headed.select(F.col("node").alias("a"), to).unionByName(headed.select(F.explode("heads").alias("a"), to).distinct())
    label = components(edges.unionByName(star.filter("a <> b")))
    discard(held, crowd, shared)
    return view(label, label.withColumnRenamed("label", "comp"))


def _known(docs: DataFrame, n: int, threshold: float, tolerance: float, tile: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(signed, known): rows (doc_id, t1, t2, has), and texts t1, t2 with first_id, class_id, lead (the class's own node), links, n_copies."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts, floors, share = n_partitions(docs.sparkSession), least_matches(threshold, tolerance, ROWS * BANDS), Fraction(str(threshold))

    def sign(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                h, at = tk.shingles(*tk.word_hashes(*tk.flat(part.column("text"))), n)
                has = np.diff(at) > 0
                sig = signatures(h, at)
                upto = lambda size: pa.array(np.concatenate([[0], np.cumsum(has * size)]), pa.int32())  # noqa: B023, E731
                buckets = pa.ListArray.from_arrays(upto(BANDS), pa.array(bands(sig).view(np.int64)[has].ravel()))
                sig = sig[has].astype(SENT)
                sig = pa.Array.from_buffers(pa.binary(), len(has), [None, upto(sig.itemsize * sig.shape[1]).buffers()[1], pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(has), buckets, sig], names=["doc_id", "t1", "t2", "has", "buckets", "sig"])
        tk.release()

    rows = docs.select("doc_id", *_text_id(), "text")
    signed = stage(rows.mapInArrow(sign, f"doc_id {kind}, t1 long, t2 long, has boolean, buckets array<long>, sig binary"), "signatures")
    nodes = signed.filter("has").groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # ids hold once they are written
    whole, signed = signed, stage(signed.select("doc_id", "t1", "t2", "has"), "texts")
    discard(whole)
    comp = _candidates(nodes, floors, bucket)

    # Small tiles spread a component over more tasks; more than SPREAD of them only where a tile would be too large, as each text is sent once a tile.
    least = max(1, tile // 8)
    # Few rows: nodes / least at most. A table of its own, so that its join is a broadcast by Spark's size check, or one whose large keys are split.
    large = stage(comp.groupBy("comp").agg(F.count("*").alias("size")).filter(F.col("size") > least), "large-components")
    n_tiles = F.least(F.ceil(F.col("size") / least), F.greatest(F.lit(SPREAD), F.ceil(F.col("size") / tile)))
    tiled = comp.join(large, "comp", "left").withColumn("n_tiles", F.coalesce(n_tiles, F.lit(1)).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("n_tiles")).cast("int"))
    own = nodes.select("node", "t1", "t2", "first_id", F.col("n_copies").alias("weight"), "sig")
    picked = stage(tiled.select("node", "comp", "n_tiles", "tile").join(own, "node"), "candidates")
    discard(comp, large)
    texts = rows.select("doc_id", F.col("t1").alias("own1"), F.col("t2").alias("own2"), "text")
    # Always a merge join: a broadcast of the candidates would fit small inputs only.
    texts = picked.hint("merge").join(texts, (F.col("t1") == F.col("own1")) & (F.col("t2") == F.col("own2")) & F.col("first_id").eqNullSafe(F.col("doc_id")))
    # A table of its own, so that the shuffle of all texts is gone when those of the candidates are sent to their tiles.
    texts = texts.select("comp", "n_tiles", "tile", "node", "weight", "sig", "text").mapInArrow(lambda it: _sets(it, n), SETS)
    sets = stage(texts, "candidate-sets")
    discard(picked)
    grouped = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))).select("comp", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "node", "weight", "tile", "sig", "shingles")
    grouped = grouped.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    linked = stage(grouped.mapInArrow(lambda it: _compare(it, share, floors), "node long, links long, root long"), "links")
    discard(sets)
    label = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lead = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", F.col("node").alias("lead"))).alias("l")
    leads = label.join(nodes.select("node", "first_id"), "node").groupBy("label").agg(lead)
    leads = stage(leads.select("label", F.col("l.first_id").alias("class_id"), "l.lead"), "classes")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    linked_to = label.join(leads, "label").join(counts, "node").select("node", F.lit(True).alias("linked"), "class_id", "lead", "links")
    known = nodes.select("node", "t1", "t2", "first_id", "n_copies").join(linked_to, "node", "left")
    own = lambda name, alone: F.when(F.col("linked"), F.col(name)).otherwise(alone).alias(name)
    known = known.select("node", "t1", "t2", "first_id", own("class_id", F.col("first_id")), own("lead", F.col("node")), own("links", F.lit(0)), "n_copies")
    return signed, known


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, tile: int = 1024, bucket: int = 256) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row for each row of docs.

    Similarity: Jaccard of the sets of n-word shingles, words split at white
    space, A-Z in lower case; a text of fewer than n words has one shingle, all
    its words. Links join texts of at least the threshold; class_id is the
    smallest doc_id of the connected component. n_links: how many other rows
    are linked, copies included; n_copies: how many rows have exactly this text.
    Null texts and texts without words link to nothing, each row a class of its
    own. Null ids: never a class_id unless the class has no other. Rows that
    repeat are copies. An empty table gives an empty result.

    A pair of similarity 0.8 shares no band with probability 4e-7 and is pruned
    with at most the tolerance; no pair is accepted without exact verification.
    tile: most texts of a component that are compared in one go with as many others; bucket: the most
    texts of a band's bucket that are compared there. Neither changes the result.
    """
    signed, known = _known(docs, n, threshold, tolerance, tile, bucket)
    own = known.select("t1", "t2", "class_id", "links", F.col("n_copies").alias("copies"))
    out = signed.filter("has").join(own, ["t1", "t2"]).select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"))
    alone = signed.filter("not has").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def one_per_class(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, tile: int = 1024, bucket: int = 256) -> DataFrame:
    """The rows of docs, with all their columns, that lead their class (see jaccard_classes); one of rows that repeat.

    Rows without any word, null texts among them, link to nothing and all stay.
    Null ids lead only where the class has no other. An empty table gives an
    empty result.
    """
    _, known = _known(docs, n, threshold, tolerance, tile, bucket)
    null_id = F.lit(2**63 - 1)
    own = fresh(docs, "class_doc", "class_t1", "class_t2")
    keep = known.filter("node = lead").select(F.coalesce(F.col("first_id").cast("long"), null_id).alias(own[0]), F.col("t1").alias(own[1]), F.col("t2").alias(own[2]))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(~wordless).withColumns(dict(zip(own, [F.coalesce(F.col("doc_id").cast("long"), null_id), *_text_id()])))
    led = keyed.join(keep, own, "left_semi").dropDuplicates(own).drop(*own)
    return led.unionByName(docs.filter(wordless))
