"""MinHash near-duplicate detection with sequential Bayesian verification.

1. A node is a distinct text (128-bit hash). MinHash bands of its shingles give
   buckets; a bucket of too many nodes is a candidate group as it stands if they
   share more buckets, else it is split by the next bands.
2. Nodes of a bucket are compared on their signatures, batch by batch; a pair
   goes as soon as the posterior probability that its similarity reaches the
   threshold is under the chosen miss probability. A forest of the pairs that
   stay leaves the bucket; its components hold all candidates together.
3. Only components of verified links are asked for, so nodes that are linked
   already needn't be compared. A tile of a component's nodes is resolved by
   itself: a node is compared with those that it isn't linked to yet, pruned as
   in 2. and then verified on the shingles. The groups that come out send one
   node each to a next round of tiles, until a round joins little.
4. What is left apart in a component of several tiles is compared in full: the
   nodes outside its largest group, in blocks, with all its nodes, in tiles. A
   group of copies thus costs as much as it has nodes, and no link is missed.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .jaccard import BANDS, ROWS, SENT, STEP, _refine, _signatures_of, _text_id, bands, least_matches, signatures
from .session import discard, n_partitions, stage, view

NEXT = 4  # bands that a large bucket is split by: texts of similarity 0.85 share no two bands that near with a probability of 4e-6
FAMILY = 4  # buckets that nodes of a large bucket share with its head on average, from which it isn't split
SETS = "node long, comp long, sig binary, shingles binary"


def floors_of(threshold: float, miss: float) -> dict[int, int]:
    """The fewest matches that keep a pair after each batch of a signature; all batches together miss a pair with at most the probability `miss`."""
    return least_matches(threshold, miss / (ROWS * BANDS // STEP), ROWS * BANDS)


def alike(one: np.ndarray, sets: list[np.ndarray], share: Fraction) -> np.ndarray:
    """Which of the sets (sorted, without repeats, none empty) reach the share with one, exactly."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate(sets)
    at = np.searchsorted(one, every)
    found = one[np.minimum(at, len(one) - 1)] == every
    common = np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)
    return common * share.denominator >= (size + len(one) - common) * share.numerator


def resolve(label: np.ndarray, left: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], floors: dict, share: Fraction, at_once: int = 256) -> np.ndarray:
    """The labels (indices) after all links between a node of `left` and any other node: the smallest of what is linked."""
    label = label.copy()
    size = np.array([len(s) for s in sets], dtype=np.int64)
    for i in left.tolist():
        apart = np.flatnonzero(label != label[i])
        if not len(apart):
            break  # all nodes are one
        # a pair whose sizes alone are too far apart can't reach the share
        least, most = np.minimum(size[apart], size[i]), np.maximum(size[apart], size[i])
        apart = apart[least * share.denominator >= most * share.numerator]
        matches, done = np.zeros(len(apart), dtype=np.int64), 0
        for upto, floor in floors.items():
            matches += (sig[apart, done:upto] == sig[i, done:upto]).sum(axis=1)
            keep = matches >= floor
            apart, matches, done = apart[keep], matches[keep], upto
        apart = apart[np.argsort(-matches, kind="stable")]  # the likeliest first
        while len(apart):
            some, apart = apart[:at_once], apart[at_once:]
            good = some[alike(sets[i], [sets[k] for k in some.tolist()], share)]
            if len(good):
                joined = np.unique(np.append(label[good], label[i]))
                label[np.isin(label, joined)] = joined[0]
                apart = apart[label[apart] != label[i]]
    return label


def _resolve(batches, share: Fraction, floors: dict):
    """Rows sorted by group (comp, i, j), with node, label, asks (whether the node is one to compare), sig and shingles; gives (node, root)."""
    held: list[tuple] = []
    key_held = None

    def close():
        node, old = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
        _, label = np.unique(old, return_inverse=True)
        first = np.full(len(held), len(held))
        np.minimum.at(first, label, np.arange(len(held)))
        left = np.flatnonzero(np.array([h[2] for h in held]))
        root = resolve(first[label], left, np.array([h[3] for h in held]), [h[4] for h in held], floors, share)
        moved = np.flatnonzero(root != first[label])
        return node[moved], node[root[moved]]  # a forest: each node with the first of its label

    out: list[tuple] = []
    for batch in batches:
        for part in tk.slices(batch, "shingles"):
            raw, at = tk.flat(part.column("shingles"))
            sig = _signatures_of(part.column("sig"))
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "i", "j", "node", "label", "asks")]
            for r, (*key, node, label, asks) in enumerate(zip(*cols)):
                if key_held != key:
                    if held:
                        out.append(close())
                    held, key_held = [], key
                if held and held[-1][0] == node:
                    continue  # a row that repeats
                held.append((node, label, asks, sig[r], np.frombuffer(raw[at[r] : at[r + 1]].tobytes(), dtype=np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
                out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in close()], names=["a", "b"])
    held.clear()
    tk.release()


def _sign(batches, n: int):
    for batch in batches:
        for part in tk.slices(batch, "text"):
            h, at = tk.shingles(*tk.word_hashes(*tk.flat(part.column("text"))), n)
            size = np.array([len(np.unique(h[s:e])) for s, e in zip(at[:-1], at[1:])], dtype=np.int64)
            has, sig = size > 0, signatures(h, at)
            upto = lambda each: pa.array(np.concatenate([[0], np.cumsum(has * each)]), pa.int32())  # noqa: B023, E731
            buckets = pa.ListArray.from_arrays(upto(BANDS), pa.array(bands(sig).view(np.int64)[has].ravel()))
            sig = sig[has].astype(SENT)
            sig = pa.Array.from_buffers(pa.binary(), len(has), [None, upto(sig.itemsize * sig.shape[1]).buffers()[1], pa.py_buffer(sig)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(size), buckets, sig], names=["doc_id", "t1", "t2", "n_shingles", "buckets", "sig"])
    tk.release()


def _sets(batches, n: int):
    """The distinct shingles of each text, in order, in place of the text; of adjacent rows of a node one stays."""
    last = None
    for batch in batches:
        node = batch.column("node").to_numpy()
        new = np.concatenate([[last is None or len(node) and node[0] != last], node[1:] != node[:-1]])[: len(node)]
        last = node[-1] if len(node) else last
        for part in tk.slices(batch.filter(pa.array(new)), "text"):
            h, at = tk.shingles(*tk.word_hashes(*tk.flat(part.column("text"))), n)
            sets = [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:])]
            upto = np.concatenate([[0], np.cumsum([8 * len(x) for x in sets])]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(upto), pa.py_buffer(np.concatenate([*sets, np.zeros(0, np.uint64)]))])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "comp", "sig")), packed], names=["node", "comp", "sig", "shingles"])
    tk.release()


def _buckets(placed: DataFrame, most: int, name: str) -> DataFrame:
    """Staged (bucket, head, n, large) of the buckets with two nodes or more; of buckets with the same nodes one is enough."""
    held = placed.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("other"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"))
    held = held.filter("n > 1").groupBy("n", "head", "other", "all").agg(F.min("bucket").alias("bucket"))
    return stage(held.select("bucket", "head", "n", (F.col("n") > most).alias("large")), name)


def _candidates(nodes: DataFrame, floors: dict, most: int) -> DataFrame:
    """Staged (node, comp): nodes that may be similar to another one, by component."""
    spark = nodes.sparkSession
    placed = nodes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    held = _buckets(placed.drop("band"), most, "buckets")
    crowd = stage(placed.join(held.filter("large").select("bucket", "head").hint("merge"), "bucket").select("node", "band", "bucket", "head"), "large-buckets")
    # Nodes that share some buckets each with the head are a family of near copies, and candidates as they stand: other ones share one bucket or two.
    shared = crowd.groupBy("node", "head").agg(F.count("*").alias("shared")).groupBy("head").agg((F.avg("shared") >= FAMILY).alias("family"))
    shared = stage(shared, "heads")
    # A large bucket of others is split by the next bands of its nodes: what is similar shares two bands that near.
    split = crowd.join(shared.filter("not family"), "head").join(nodes.select("node", "buckets"), "node")
    split = split.select("node", "bucket", F.explode(F.transform(F.sequence(F.lit(1), F.lit(NEXT)), lambda d: F.get("buckets", (F.col("band") + d) % BANDS))).alias("further"))
    split = stage(split.select("node", F.xxhash64("bucket", "further").alias("bucket")), "split-buckets")
    finer = _buckets(split, most, "finer-buckets")
    small = lambda where, which: where.join(which.filter("not large").select("bucket").hint("merge"), "bucket").select("bucket", "node")
    met = small(placed, held).unionByName(small(split, finer)).join(nodes.select("node", "sig"), "node")
    met = met.select("bucket", "node", "sig").repartition(n_partitions(spark), F.xxhash64("bucket")).sortWithinPartitions("bucket")
    edges = met.mapInArrow(lambda it: _refine(it, floors), "a long, b long")
    # So is what shares two bands with so many others. A node goes to the smallest of its heads, and its other heads go there too.
    headed = crowd.join(shared.filter("family"), "head").select("node", "head")
    headed = headed.unionByName(split.join(finer.filter("large").select("bucket", "head").hint("merge"), "bucket").select("node", "head"))
    headed = headed.groupBy("node").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    to = F.col("heads")[0].alias("b")
    star = headed.select(F.col("node").alias("a"), to).unionByName(headed.select(F.explode("heads").alias("a"), to).distinct())
    label = components(edges.unionByName(star.filter("a <> b")))
    discard(held, crowd, shared, split, finer)
    return view(label, label.withColumnRenamed("label", "comp"))


def _groups(members: DataFrame, tile: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Staged: members (node, comp, label, asks) with n_tiles and i, their tile, without components of one node; (comp, n_tiles)."""
    size = members.groupBy("comp").agg(F.count("*").alias("size")).filter("size > 1")
    size = stage(size.select("comp", F.ceil(F.col("size") / tile).cast("int").alias("n_tiles")), "component-sizes")
    return stage(members.join(size, "comp").withColumn("i", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("n_tiles")).cast("int")), "tiled"), size


def _links(sets: DataFrame, groups: DataFrame, share: Fraction, floors: dict) -> DataFrame:
    """(a, b) staged: what each group (comp, i, j) of groups (node, comp, label, asks, i, j) links."""
    rows = groups.join(sets.drop("comp").hint("merge"), "node").select("comp", "i", "j", "node", "label", "asks", "sig", "shingles")
    rows = rows.repartition(n_partitions(sets.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    return stage(rows.mapInArrow(lambda it: _resolve(it, share, floors), "a long, b long"), "near-links")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp, label), staged, after links between nodes; a label is a node of its group."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    between = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    found = components(between)
    out = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("better")), "label", "left")
    out = stage(out.select("node", "comp", F.coalesce("better", "label").alias("label")), "near-labels")
    discard(found, links, labels)
    return out


def _resolved(sets: DataFrame, share: Fraction, floors: dict, tile: int) -> DataFrame:
    """(node, label) staged: verified components of sets (node, comp, sig, shingles)."""
    labels = stage(sets.select("node", "comp", F.col("node").alias("label")).distinct(), "near-labels")
    left, turn, size = None, 0, None
    while True:
        heads = labels.filter("node = label").select("node", "comp", "label", F.lit(True).alias("asks"))
        # The heads of a component that lay in one tile have met.
        heads = heads if size is None else heads.join(size.filter("n_tiles > 1").select("comp"), "comp", "left_semi")
        before = size
        tiled, size = _groups(heads, tile, turn)
        discard(*[before] if before else [])
        n = tiled.count()
        if n and (left is None or n <= 0.75 * left):
            labels = _relabel(labels, _links(sets, tiled.withColumn("j", F.lit(0)), share, floors))
            left, turn = n, turn + 1
            discard(tiled)
        else:
            discard(tiled, size)
            break
    # What is left apart: the nodes outside a component's largest group with all nodes of it. Components that one tile held are done.
    by_label = labels.groupBy("comp", "label").agg(F.count("*").alias("n"))
    ranked = by_label.groupBy("comp").agg(F.sum("n").alias("size"), F.count("*").alias("groups"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"))
    open_ = ranked.filter((F.col("groups") > 1) & (F.col("size") > tile))
    open_ = open_.select("comp", "main", F.ceil(F.col("size") / tile).cast("int").alias("n_tiles"), F.ceil((F.col("size") - F.col("most")) / tile).cast("int").alias("n_blocks"))
    open_ = stage(open_, "open-components")
    if open_.limit(1).count():
        own = labels.join(open_, "comp")
        spot = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = own.filter("label <> main").select("node", "comp", "label", F.lit(True).alias("asks"), spot("n_blocks").alias("i"), each("n_tiles").alias("j"))
        asked = own.select("node", "comp", "label", F.lit(False).alias("asks"), each("n_blocks").alias("i"), spot("n_tiles").alias("j"))
        both = asking.unionByName(asked).groupBy("node", "comp", "label", "i", "j").agg(F.max("asks").alias("asks"))
        labels = _relabel(labels, _links(sets, both, share, floors))
    discard(open_)
    return labels


def near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.85, miss: float = 1e-6, tile: int = 512, bucket: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Two texts are linked if the Jaccard similarity of their sets of n-word
    shingles is the threshold or more, verified on the sets; words are split at
    white space, A-Z in lower case; a text of fewer words has one shingle, all
    its words. component_id: the smallest doc_id that is reachable; kept: whether
    it is the row's own. Null texts and texts without words have no shingles and
    link to nothing. A null id is a component's id only where it has no other,
    and its row is never kept. Rows that repeat are copies and have one result
    each. Other columns aren't read. An empty table gives an empty result.

    A pair at the threshold is pruned with at most the probability `miss`, and
    shares no band with less than 1e-8, no two near ones, where all its buckets
    hold over `bucket` texts, with 4e-6. tile: most texts that one task compares
    at once (twice as many in the end). Neither changes the result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    floors, share = floors_of(threshold, miss), Fraction(str(threshold))
    rows = docs.select("doc_id", *_text_id(), "text")
    signed = stage(rows.mapInArrow(lambda it: _sign(it, n), f"doc_id {kind}, t1 long, t2 long, n_shingles long, buckets array<long>, sig binary"), "signatures")
    nodes = signed.filter("n_shingles > 0").groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # ids hold once they are written
    whole, signed = signed, stage(signed.select("doc_id", "t1", "t2", "n_shingles"), "texts")
    discard(whole)
    comp = _candidates(nodes, floors, bucket)
    picked = stage(comp.join(nodes.select("node", "t1", "t2", "first_id", "sig"), "node"), "candidates")
    discard(comp)
    texts = rows.select(F.col("doc_id").alias("own_id"), F.col("t1").alias("own1"), F.col("t2").alias("own2"), "text")
    # Always a merge join, for a broadcast of the candidates would fit small inputs only; it leaves rows that repeat side by side.
    texts = picked.hint("merge").join(texts, (F.col("t1") == F.col("own1")) & (F.col("t2") == F.col("own2")) & F.col("first_id").eqNullSafe(F.col("own_id")))
    sets = stage(texts.select("node", "comp", "sig", "text").mapInArrow(lambda it: _sets(it, n), SETS), "candidate-sets")
    discard(picked)
    labels = _resolved(sets, share, floors, tile)
    discard(sets)
    least = labels.join(nodes.select("node", "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("least"))
    least = labels.join(least, "label").select("node", F.lit(True).alias("linked"), "least")
    known = nodes.select("node", "t1", "t2", "first_id").join(least, "node", "left")
    known = known.select("t1", "t2", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first_id")).alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    out = signed.filter("n_shingles > 0").join(known, ["t1", "t2"]).select("doc_id", "n_shingles", "component_id", kept)
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").isNotNull().alias("kept"))
    return out.unionByName(alone)
