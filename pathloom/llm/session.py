"""Session helpers: the shared folder for staged tables, and small plan utilities."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_LEFT: dict[str, SparkSession] = {}  # staged tables that are still there


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and all is one machine (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        own = tempfile.TemporaryDirectory(prefix="pathloom-")
        atexit.register(own.cleanup)
        _OWN.append(own.name)
    return _OWN[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again.

    The table outlives executors. Shuffle files of the finished job are
    dropped at once, so that the peak of disk is that of one job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, "false")
    spark.conf.set(option, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(option, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _LEFT[path] = spark
    return out


def view(staged: DataFrame, out: DataFrame) -> DataFrame:
    """`out`, made of the staged table alone, as something that discard() takes."""
    out._staged_at = staged._staged_at
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them must be staged itself."""
    for df in staged:
        _delete(df.sparkSession, df._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy() -> None:
    """Delete all tables that are still staged: once the results that read them have been written. Done when the driver ends, too."""
    for path, spark in list(_LEFT.items()):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone
                _delete(spark, path)


atexit.register(tidy)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column of that name already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) leaves `remainder`; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
