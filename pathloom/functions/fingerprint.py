"""Content fingerprints: BLAKE2b of 16 bytes over the size and the content, or its two ends."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

END = 64 * 1024


def _digest(size: int, *parts: bytes) -> str:
    h = hashlib.blake2b(size.to_bytes(8, "little"), digest_size=16)
    for part in parts:
        h.update(part)
    return h.hexdigest()


def of_bytes(content: bytes) -> str:
    size = len(content)
    return _digest(size, content) if size <= 2 * END else _digest(size, content[:END], content[-END:])


def of_file(path: str | Path) -> str:
    """Reads 128 KiB at most."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(0)
        if size <= 2 * END:
            return _digest(size, f.read())
        head = f.read(END)
        f.seek(-END, 2)
        return _digest(size, head, f.read(END))


def content_fingerprint(content: Column) -> Column:
    """Fingerprint of a binary column; null stays null."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else of_bytes(bytes(b)))

    return digest(content)


def path_fingerprint(path: Column) -> Column:
    """Fingerprint of the file at a path that the executors can open; null if it can't be read."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        def one(path):
            try:
                return None if path is None else of_file(path)
            except OSError:
                return None

        return values.map(one)

    return digest(path)
