"""Vectorised text primitives shared by the training-data operators.

Everything works on one flat UTF-8 buffer per Arrow slice, so a batch of
documents costs a fixed number of numpy passes instead of a Python loop a row.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute

# The six bytes that end a word.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i for i < n at least (mod 2**64), kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on, and their executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; see span_hash."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    if len(buf):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [lo, hi), equal for equal bytes wherever they stand."""
    return mix64((prefix[hi] - prefix[lo]) * _power(_INVERSE, len(prefix))[lo])


def window_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte window of the buffer, windows across documents included."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = prefix_hash(buf)
    return mix64((prefix[k:] - prefix[:-k]) * _power(_INVERSE, n)[:n])


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): document i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_binary())
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, target: int = 1 << 20):
    """Sub-batches of about `target` bytes of text; a longer document makes one of its own."""
    col = batch.column(column)
    if len(col) == 0:
        return
    size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(col):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + target, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(batch: pa.RecordBatch, column: str, target: int, overlap: int):
    """(first row, bytes, offsets, place of the first byte in its document): slices, and a document of over `target` bytes in overlapping pieces.

    A piece has `overlap` bytes of the next one, so that each string of up to overlap + 1 bytes lies in one whole.
    """
    row = 0
    for part in slices(batch, column, target):
        buf, offsets = flat(part.column(column))
        if len(buf) > target + overlap:
            for at in range(0, len(buf) - overlap, target):
                piece = buf[at : at + target + overlap]
                yield row, piece, np.array([0, len(piece)], dtype=np.int64), at
        else:
            yield row, buf, offsets, 0
        row += part.num_rows


def word_pieces(buf: np.ndarray, offsets: np.ndarray, target: int = 1 << 20, space=_IS_SPACE):
    """(first document, bytes, offsets): all at once, or where it is over twice the target, each document in pieces that end before a space."""
    if len(buf) <= 2 * target:
        yield 0, buf, offsets
        return
    for doc, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while at < end:
            stop = at + target
            while stop < end and not (found := np.flatnonzero(space[buf[stop : min(end, stop + 4096)]])).size:
                stop += 4096
            stop = end if stop >= end or end - at <= 2 * target else stop + int(found[0])
            yield doc, buf[at:stop], np.array([0, stop - at], dtype=np.int64)
            at = stop


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): spans of the words and, per document, the index of its first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    end = np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets, side="left")


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of each document's first word)."""
    parts, count = [np.zeros(0, dtype=np.uint64)], np.zeros(len(offsets) - 1, dtype=np.int64)
    for doc, piece, at in word_pieces(buf, offsets):
        start, end, first = words(piece, at)
        parts.append(span_hash(prefix_hash(lower(piece)), start, end))
        count[doc : doc + len(at) - 1] += np.diff(first)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])


def shingles(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-word shingle, index of each document's first shingle).

    short: a document of 1 to n - 1 words has one shingle, all of its words.
    """
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    mult = _power(_BASE, n + 1)
    acc = np.zeros(max(len(hashes) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        acc += hashes[i : i + len(acc)] * mult[i + 1]
    keep = np.repeat(full > 0, count)
    where = np.arange(len(hashes)) - np.repeat(first[:-1], count)
    keep &= where < np.repeat(full, count)
    out = mix64(acc[np.flatnonzero(keep)])
    if not short or not (lone := np.flatnonzero((count > 0) & (count < n))).size:
        return out, np.concatenate([[0], np.cumsum(full)])
    per = full.copy()
    per[lone] = 1
    at = np.concatenate([[0], np.cumsum(per)])
    whole = np.empty(at[-1], dtype=np.uint64)
    is_lone = np.zeros(at[-1], dtype=bool)
    is_lone[at[lone]] = True
    whole[~is_lone] = out
    for d in lone:
        h = hashes[first[d] : first[d + 1]]
        whole[at[d]] = mix64((h * mult[1 : len(h) + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0]
    return whole, at
