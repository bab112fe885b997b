"""A catalog table as plain Parquet, dealt by folder to parts, of which a change overwrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

MOST_PARTS = 1 << 15


class PartTable:
    """Rows below `folder`/of=N/part=K, written by Spark's dynamic partition overwrite.

    A row's part is the hash of the folder it stands in, so that the changes of a
    batch, which lie in few folders, touch few parts. The number of parts is
    chosen when the table is written whole, by its rows, and stands in the name of
    its folder. A large part is written by several tasks. A change is
    visible when the job that makes it commits; the table has one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, part_rows: int = 50_000, least: int = 16):
        self.spark, self.folder, self.schema, self.part_rows, self.least = spark, folder.rstrip("/"), schema, part_rows, least

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        fs, top = self._fs(), self._path(*folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []

    def parts(self) -> int:
        """The number of parts, 0 before the first write."""
        whole = [n for n in self._names() if n.startswith("of=") and "_SUCCESS" in self._names(n)]
        return max((int(n.removeprefix("of=")) for n in whole), default=0)

    def part_of(self, path: Column, parts: int | None = None) -> Column:
        return F.pmod(F.xxhash64(paths.parent(path)), F.lit(parts or self.parts())).cast("int")

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of the given parts: other folders aren't looked at."""
        n = self.parts()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.folder}/of={n}")
        return (rows if parts is None else rows.filter(F.col("part").isin(parts))).select(columns)

    def _put(self, rows: DataFrame, n: int, touched: list[int] | None) -> None:
        seen = Observation()
        dealt = rows.withColumn("part", self.part_of(F.col("path"), n)).observe(seen, F.bitmap_construct_agg(F.col("part").cast("long")).alias("parts"))
        dealt = dealt.hint("rebalance", "part")  # a part is one file, or several where its rows are more than one task should write
        mode = "dynamic" if n == self.parts() else "static"  # a layout that is there is overwritten part by part
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("part").parquet(f"{self.folder}/of={n}")
        bits = seen.get["parts"]
        written = {8 * i + k for i, byte in enumerate(bits) for k in range(8) if byte >> k & 1}
        for name in self._names(f"of={n}"):  # what is left without rows
            part = int(name.removeprefix("part=")) if name.startswith("part=") else -1
            if part >= 0 and part not in written and (touched is None or part in touched):
                self._fs().delete(self._path(f"of={n}", name), True)

    def write(self, rows: DataFrame, touched: list[int] | None = None) -> None:
        """`rows` are all rows of the touched parts (None: of the table, whose number of parts follows their number)."""
        if touched is not None:
            if touched:
                self._put(rows, self.parts(), touched)
            return
        n, before = self.least, self.parts()
        count = rows.count()
        while n * self.part_rows < count and n < MOST_PARTS:
            n *= 2
        self._put(rows, n, None)
        if before and before != n:
            self._fs().delete(self._path(f"of={before}"), True)

    def touched(self, changed: DataFrame) -> list[int]:
        """The parts that paths fall in, at most as many as the table has."""
        found = changed.filter("path is not null").select(self.part_of(F.col("path")).alias("part")).distinct()
        return sorted(r.part for r in found.collect())

    def update(self, changed: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrite the parts of the changed paths: `change` gets their rows and gives what they become. The parts that were."""
        if not self.parts():
            self.write(change(self.read()))
            return list(range(self.parts()))
        parts = self.touched(changed)
        self.write(change(self.read(parts)), parts)
        return parts
