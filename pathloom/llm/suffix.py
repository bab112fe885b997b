"""Removing repeated byte strings with suffix arrays.

A string of `length` bytes can only repeat where its anchor repeats: the
smallest hash of the k-byte strings in it. Consecutive strings of a document
with one anchor form a segment.

1. Anchors are counted (combined before the shuffle); only segments whose
   anchor occurs more than once are kept, with their bytes.
2. Segments of equal bytes are merged: all strings of all but the first
   segment occur earlier.
3. The different segments of an anchor go through a suffix array, built by
   two-stage sorting: suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets. Adjacent common
   prefixes of at least `length` bytes give the strings that repeat; all but
   the first in (document, start) order are marked.
4. An anchor whose different segments hold more than `most_bytes` (a very
   frequent line in ever new surroundings) would make one task large. Its
   segments are cut by where the anchor stands in a string, and the pieces dealt
   by the bytes around the anchor that all strings of a piece share; equal
   strings still meet. Pieces go through 2. and 3. again, and what is still
   over the bound is cut into single strings, which 2. merges.
5. Marked ranges are put together by document, and the bytes outside are kept.

A worker holds slices of text, segments and sort groups of bounded bytes, also
of one very long document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .session import discard, n_partitions, stage

LONGEST = 4096  # strings in a segment; longer runs are cut
PIECE = 1 << 18  # bytes of text or of segments at once
CUTS = (16, 1)  # strings in a piece of a segment that is cut, first and second time


def two_stage_sort(text: np.ndarray, raw: bytes, ends: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of text (byte + 1, with 0 after each segment); equal suffixes stand in order of place.

    raw: the same text as bytes; ends: for each place, where its segment ends.
    depth: suffixes need be in order of their first `depth` bytes only (an
    induced suffix is one byte longer than what induces it), which bounds the
    keys of the direct sort.
    """
    n = len(text)
    step = np.ones(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    decides = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    smaller = step[decides] > 0  # than the successor: sorted directly
    smaller[text == 0] = True

    direct = np.flatnonzero(smaller & (text != 0))
    upto = ends[direct] if depth is None else np.minimum(ends[direct], direct + depth)
    keys = [raw[i:e] for i, e in zip(direct.tolist(), upto.tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    buckets = {0: np.flatnonzero(text == 0)}
    chars = text[direct]
    cut = np.flatnonzero(np.diff(chars)) + 1
    for part in np.split(direct, cut):
        if len(part):
            buckets[int(text[part[0]])] = part
    pending: dict[int, list[np.ndarray]] = {}
    out = []
    for c in range(int(text.max()) + 1 if n else 0):
        induced = pending.pop(c, [])
        now = np.concatenate(induced) if induced else np.zeros(0, dtype=np.int64)
        whole = [now]
        while len(now):  # a suffix of this bucket may induce another one in it
            before = now[now > 0] - 1
            now = before[(text[before] == c) & ~smaller[before]]
            if len(now):
                whole.append(now)
        if c in buckets:
            whole.append(buckets[c])
        order = np.concatenate(whole)
        out.append(order)
        before = order[order > 0] - 1
        before = before[~smaller[before] & (text[before] > c)]
        if len(before):
            char = text[before]
            by = np.argsort(char, kind="stable")
            before, char = before[by], char[by]
            for part in np.split(before, np.flatnonzero(np.diff(char)) + 1):
                pending.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of `length` bytes (8 at least) at a[i] and b[i] are equal."""
    word = np.ndarray(shape=(max(len(raw) - 7, 0),), dtype="<u8", buffer=raw, strides=(1,))
    alive = np.arange(len(a))
    for at in [*range(0, length - 7, 8), length - 8]:
        alive = alive[word[a[alive] + at] == word[b[alive] + at]]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def repeats(raw: bytes, size: np.ndarray, docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, text hash, start, end) of the ranges whose strings occur earlier among the given segments.

    raw: the segments, each closed by a zero byte; size: their bytes without it.
    """
    edge = np.cumsum(size + 1)
    first = edge - size - 1
    data = np.frombuffer(raw, dtype=np.uint8)
    text = data.astype(np.uint16) + 1
    text[edge - 1] = 0
    ends = np.repeat(edge - 1, size + 1)
    order = two_stage_sort(text, raw, ends, length)
    order = order[ends[order] - order >= length]  # a whole string starts here
    same = common_prefix(data, order[:-1], order[1:], length)
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    many = np.bincount(group)[group] > 1 if len(order) else group.astype(bool)
    order, group = order[many], group[many]
    seg = np.searchsorted(edge, order, side="right")
    doc, text_hash, start = docs[seg], hashes[seg], starts[seg] + order - first[seg]
    by = np.lexsort((start, text_hash, doc, group))
    again = np.zeros(len(by), dtype=bool)
    again[1:] = group[by][1:] == group[by][:-1]
    # The same place may come twice; it isn't earlier than itself.
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(by)))) if len(by) else by
    own = (doc[by] == doc[by][lead]) & (text_hash[by] == text_hash[by][lead]) & (start[by] == start[by][lead])
    hit = by[again & ~own]
    doc, text_hash, start = doc[hit], text_hash[hit], start[hit]
    by = np.lexsort((start, text_hash, doc))
    return _ranges(doc[by], text_hash[by], start[by], length)


def _ranges(doc, text_hash, start, length):
    if not len(doc):
        return doc, text_hash, start, start
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (start[1:] - start[:-1] > length)
    at = np.flatnonzero(new)
    return doc[at], text_hash[at], start[at], start[np.append(at[1:], len(doc)) - 1] + length


def segments(buf: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, document, start in the document, number of strings, whether the anchor occurs twice in it)."""
    hashes = tk.window_hash(buf, k)
    width = length - k + 1
    n = len(buf) - length + 1
    empty = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return empty.view(np.uint64), empty, empty, empty, empty.astype(bool)
    low, span, near = hashes, 1, (hashes, 1)
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span * 2 <= width + 1:
            near = low, span
    anchor = np.minimum(low[:n], low[width - span : width - span + n])
    size = np.diff(offsets)
    long_ = size >= length
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, offsets[:-1][long_], 1)
    np.add.at(change, (offsets[1:] - length + 1)[long_], -1)
    valid = np.cumsum(change[:n]) > 0
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return empty.view(np.uint64), empty, empty, empty, empty.astype(bool)
    count = np.add.reduceat(valid.astype(np.int64), at)
    if count.max() > LONGEST:
        parts = -(-count // LONGEST)
        which = np.repeat(np.arange(len(at)), parts)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = np.minimum(count[which] - piece * LONGEST, LONGEST)
        at, count = at[which] + piece * LONGEST, cut
    key = anchor[at]
    # An anchor that stands twice in a segment is the smallest hash of its neighbourhood on one side or the other.
    low, span = near
    local = np.zeros(len(hashes), dtype=bool)
    local[: len(low)] = hashes[: len(low)] == low
    local[span - 1 :] |= hashes[span - 1 :] == low
    place = np.flatnonzero(local)
    lo, hi = np.searchsorted(place, at), np.searchsorted(place, at + count + width - 1)
    lens = hi - lo
    total = int(lens.sum())
    use = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(lo, lens)
    equal = hashes[place[use]] == np.repeat(key, lens)
    twice = np.bincount(np.repeat(np.arange(len(at)), lens), equal, minlength=len(at)) > 1.5
    doc = np.searchsorted(offsets, at, side="right") - 1
    return key, doc, at - offsets[doc], count, twice


def _segment_rows(batches, length: int, k: int):
    for batch in batches:
        for row, buf, offsets, base in tk.pieces(batch, "text", PIECE, length - 1):
            key, doc, start, count, twice = segments(buf, offsets, length, k)
            # start, count and the flag in one value keeps the rows of the largest shuffle short
            packed = ((start + base) << 14) | (count << 1) | twice
            yield _batch(key=key.view(np.int64), did=_numbers(batch, "did")[row + doc], th=_numbers(batch, "th")[row + doc], packed=packed)
    tk.release()


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _gather(buf: np.ndarray, at: np.ndarray, size: np.ndarray, gap: int = 0) -> np.ndarray:
    """The spans buf[at : at + size] one after the other, each followed by `gap` zeros."""
    total = np.cumsum(size + gap)
    out = np.zeros(int(total[-1]) if len(total) else 0, dtype=np.uint8)
    to = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[to + np.repeat(total - size - gap, size)] = buf[to + np.repeat(at, size)]
    return out


def _binary(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    data = _gather(buf, at, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])


def _parts(size: np.ndarray, target: int = PIECE):
    """Slices (from, to) of rows that hold about `target` bytes together."""
    ends, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + target, side="right")))
        yield start, stop
        start = stop


def _contents(batches, length: int):
    """The bytes of each row's segments (found: (key, packed))."""
    for batch in batches:
        for part in tk.slices(batch, "text", PIECE):
            buf, offsets = tk.flat(part.column("text"))
            lists = part.column("found")
            row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            found = lists.flatten()
            key, packed = (found.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            start, count = packed >> 14, (packed >> 1) & 8191
            at, size = offsets[row] + start, count + length - 1
            did, th = _numbers(part, "did")[row], _numbers(part, "th")[row]
            for s, e in _parts(size):
                yield _batch(key=key[s:e], did=did[s:e], th=th[s:e], start=start[s:e], n=count[s:e], twice=pa.array((packed[s:e] & 1).astype(bool)), content=_binary(buf, at[s:e], size[s:e]))
    tk.release()


SEGMENT = "key long, did long, th long, start long, n long, twice boolean, content binary"


def _cut(batches, length: int, k: int, width: int):
    """Segments (key, anchor, ...) in pieces of at most `width` strings that have the anchor at one place, with a key of the bytes around it that all of them share."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("content")).to_numpy(zero_copy_only=False).astype(np.int64)
        for s, e in _parts(sizes, PIECE // 4):
            part = batch.slice(s, e - s)
            buf, offsets = tk.flat(part.column("content"))
            seg = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            hashes = tk.window_hash(buf, k)
            anchor = _numbers(part, "anchor").view(np.uint64)
            stands = np.flatnonzero(hashes == anchor[seg[: len(hashes)]])
            stands = stands[stands + k <= offsets[1:][seg[stands]]]
            at = np.arange(len(buf))[np.arange(len(buf)) + length <= offsets[1:][seg]]  # where strings start
            place = stands[np.searchsorted(stands, at)]  # the first anchor from there on; each string has one
            block = (place - at) // width
            new = np.ones(len(at), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (block[1:] != block[:-1]) | (seg[at][1:] != seg[at][:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(at)))
            first, place, block = at[head], place[head], block[head]
            # the strings of a block start block * width to block * width + width - 1 bytes before the anchor
            lo, hi = place - block * width, place - block * width + length - width + 1
            prefix = tk.prefix_hash(buf)
            shared = tk.span_hash(prefix, lo, np.minimum(hi, len(buf))) ^ tk.mix64(block.astype(np.uint64))
            own = seg[first]
            key = tk.mix64(shared + _numbers(part, "key").view(np.uint64)[own])
            yield _batch(
                key=key.view(np.int64),
                did=_numbers(part, "did")[own],
                th=_numbers(part, "th")[own],
                start=_numbers(part, "start")[own] + first - offsets[own],
                n=count,
                twice=pa.array(np.zeros(len(own), dtype=bool)),
                content=_binary(buf, first, count + length - 1),
                anchor=anchor[own].view(np.int64),
            )
    tk.release()


def _sort_groups(batches, length: int):
    """Rows sorted by anchor; whole anchors are put together to texts of about PIECE bytes. An anchor holds a bounded number of bytes."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0

    def solve(table: pa.Table):
        buf, offsets = tk.flat(table.column("content"))
        size = np.diff(offsets)
        raw = _gather(buf, offsets[:-1], size, 1).tobytes()
        did, th, s, e = repeats(raw, size, *(_numbers(table, c) for c in ("did", "th", "start")), length)
        return _batch(did=did, th=th, s=s, e=e)

    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("content")).to_numpy(zero_copy_only=False).astype(np.int64)
        for s, e in _parts(sizes):
            held.append(batch.slice(s, e - s))
            bytes_held += int(sizes[s:e].sum())
            if bytes_held < PIECE:
                continue
            table = pa.Table.from_batches(held)
            key = _numbers(table, "key")
            cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
            if cut:
                yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                bytes_held = sum(int(pa.compute.sum(pa.compute.binary_length(b.column("content"))).as_py() or 0) for b in held)
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield solve(table)
    tk.release()


SPANS = pa.struct([("s", pa.int64()), ("e", pa.int64())])


def _cut_out(batches):
    for batch in batches:
        for part in tk.slices(batch, "text", 4 * PIECE):
            raw, offsets = tk.flat(part.column("text"))
            lists = part.column("found")
            n_found = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), n_found)
            s, e = (offsets[row] + found.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.lexsort((e, s))
            s, e, row = s[order], e[order], row[order]
            far = np.maximum.accumulate(e) if len(e) else e
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] > far[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            s, e, row = s[head], far[np.append(head[1:], len(far)) - 1] if len(head) else e[head], row[head]
            per = np.bincount(row, minlength=part.num_rows)
            removed = np.bincount(row, e - s, part.num_rows).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(per)])
            digests = []
            for i in range(part.num_rows):
                digest, at = hashlib.sha256(), int(offsets[i])
                for a, b in zip(s[first[i] : first[i + 1]].tolist(), e[first[i] : first[i + 1]].tolist()):
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at : offsets[i + 1]])
                digests.append(digest.hexdigest())
            spans = pa.StructArray.from_arrays([pa.array(s - offsets[row]), pa.array(e - offsets[row])], fields=list(SPANS))
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(per), pa.array(digests, pa.string()), spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    tk.release()


def _range(start, end):
    return [start.cast("long").alias("s"), end.cast("long").alias("e")]


def repeated_ranges(docs: DataFrame, length: int = 100, k: int = 20, most_bytes: int = PIECE) -> DataFrame:
    """(did, th, s, e): byte ranges to remove, overlapping ones included, by document reference.

    did: doc_id, or the largest long for null; th: hash of the text.
    """
    if not 8 <= k < length:
        raise ValueError("8 <= k < length")
    parts = n_partitions(docs.sparkSession)
    found = stage(docs.select("did", "th", "text").mapInArrow(lambda it: _segment_rows(it, length, k), "key long, did long, th long, packed long"), "anchored")
    often = found.groupBy("key").agg(F.sum(F.lit(1) + F.col("packed") % 2).alias("n")).filter("n > 1").select("key")
    often = stage(often, "anchors")
    mine = found.join(often, "key").groupBy("did", "th").agg(F.collect_set(F.struct("key", "packed")).alias("found"))
    content = docs.join(mine, ["did", "th"]).select("did", "th", "text", "found").mapInArrow(lambda it: _contents(it, length), SEGMENT)
    same = ["key", "h1", "h2"]  # equal bytes, by 128 bits more than the anchor's
    hashed = {"h1": F.xxhash64("content"), "h2": F.xxhash64(F.lit(1), "content")}
    level = stage(content.withColumn("anchor", F.col("key")).withColumns(hashed), "segments")
    discard(often, found)

    # What a join gives and what a sort gives are tables of their own: a join's large keys are split over tasks, a sort's groups are bounded.
    out = []
    for width in (*CUTS, None):
        here = F.struct("did", "th", "start")
        first = level.groupBy(*same).agg(F.min(F.struct("did", "th", "start", "content")).alias("f"), F.max("twice").alias("twice"), F.first("anchor").alias("anchor"))
        first = stage(first.select(*same, "f.*", "twice", "anchor"), "first-segments")
        lead = first.select(*same, here.alias("lead"))
        later = level.select(*same, "did", "th", "start", "n").join(lead, same).filter(here != F.col("lead"))
        out.append(stage(later.select("did", "th", *_range(F.col("start"), F.col("start") + F.col("n") + (length - 1))), "ranges"))
        discard(level)
        if width is None:  # single strings: all that are equal have met
            discard(first)
            break
        held = first.groupBy("key").agg(F.count("*").alias("width"), F.max("twice").alias("self"), F.sum(F.octet_length("content")).alias("bytes"))
        held = stage(held.filter("width > 1 or self"), "anchor-widths")
        small = F.col("bytes") <= most_bytes
        sortable = first.join(held.filter(small).select("key"), "key").select("key", "did", "th", "start", "content")
        # Dealt by another value than the join's, else Spark drops the exchange and may split a skewed key over tasks.
        sortable = sortable.repartition(parts, F.xxhash64("key")).sortWithinPartitions("key")
        out.append(stage(sortable.mapInArrow(lambda it: _sort_groups(it, length), "did long, th long, s long, e long"), "ranges"))
        if not held.filter(~small).limit(1).count():
            discard(first, held)
            break
        large = first.join(held.filter(~small).select("key"), "key").select("key", "anchor", "did", "th", "start", "content")
        large = large.mapInArrow(lambda it, width=width: _cut(it, length, k, width), f"{SEGMENT}, anchor long")
        level = stage(large.withColumns(hashed), "segments")
        discard(first, held)
    ranges = out[0]
    for more in out[1:]:
        ranges = ranges.unionByName(more)
    return ranges


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 20, most_bytes: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row for each row of docs.

    Removed is each byte covered by a string of `length` bytes that starts
    earlier too: in a document of smaller doc_id, or further left in the same
    one, as judged on the input. Null texts are empty. A null doc_id comes
    last; of different texts with equal doc_id one is taken as the earlier, by
    a hash of the text; rows equal in both are one document and judged alike.
    Texts shorter than `length` stay whole. spans: the removed runs (s, e).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "th": F.xxhash64("text")})
    ranges = repeated_ranges(rows, length, k, most_bytes)
    # ranges stays until the caller has read the result
    merged = ranges.groupBy("did", "th").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    return rows.join(merged, ["did", "th"], "left").select("doc_id", "text", "found").mapInArrow(
        _cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s: long, e: long>>"
    )
