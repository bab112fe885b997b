"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a Spark application."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    top = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="pathloom-", suffix=".zip")
    os.close(handle)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))  # executors fetch it from here while the driver runs
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    _DONE.add(context.applicationId)
