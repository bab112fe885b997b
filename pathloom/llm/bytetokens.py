"""Byte-level tokens: a lookup table over a flat UTF-8 buffer finds them, xxhash groups equal ones, and their bytes are compared."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

# All bytes but 00-40, 5B-60 and 7B-7F, the letters A-Z and a-z and every byte of a longer code point.
IS_TERM = np.ones(256, dtype=bool)
IS_TERM[0x00:0x41] = IS_TERM[0x5B:0x61] = IS_TERM[0x7B:0x80] = False
# A-Z and a-z; the lead byte of U+00C0 to U+00FF is C3, whatever byte follows it belongs to the letter.
_IS_LETTER = IS_TERM.copy()
_IS_LETTER[0x80:] = False
_IS_LETTER[0xC3] = True


def latin_letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0 to U+00FF; the buffer starts at a code point."""
    out = _IS_LETTER[buf]
    out[1:] |= buf[:-1] == 0xC3
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the maximal runs of bytes that are inside, cut at documents, and the index of each document's first one (n + 1 values)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(inside)]
    begins[edge] = inside[edge]
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets, side="left")


def _differ(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the slices of the given sizes (over 0) that start at a and at b differ."""
    out = np.zeros(len(a), dtype=bool)
    ends, at = np.cumsum(size), 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
        starts = np.cumsum(size[at:stop]) - size[at:stop]
        step = np.arange(starts[-1] + size[stop - 1]) - np.repeat(starts, size[at:stop])
        unlike = buf[np.repeat(a[at:stop], size[at:stop]) + step] != buf[np.repeat(b[at:stop], size[at:stop]) + step]
        out[at:stop] = np.logical_or.reduceat(unlike, starts)
        at = stop
    return out


def group(buf: np.ndarray, start: np.ndarray, end: np.ndarray, digest=xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(id of each slice, one slice of each id): ids are equal where the bytes are; slices that share a hash by chance are told apart."""
    raw = buf.tobytes()
    key = np.fromiter((digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist())), dtype=np.uint64, count=len(start))
    _, rep, ids = np.unique(key, return_index=True, return_inverse=True)
    size = end - start
    wrong = size != size[rep][ids]
    same = np.flatnonzero(~wrong)
    wrong[same] = _differ(buf, start[same], start[rep][ids[same]], size[same])
    if wrong.any():
        own: dict[bytes, int] = {}
        more = list(rep)
        for i in np.flatnonzero(wrong).tolist():
            if (at := own.setdefault(raw[start[i] : end[i]], len(more))) == len(more):
                more.append(i)
            ids[i] = at
        rep = np.array(more)
    return ids, rep
