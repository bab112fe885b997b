"""Tables of roots and of opened files, with their types held; a table that isn't there is empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOTS = "ord int, name string, path string, is_network boolean"
ACCESS = "file string, open_count long, last_opened long"


def _load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def load_roots(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, path, is_network) in order; rows without a name or path don't count."""
    return _load(spark, path, ROOTS).dropna(subset=["name", "path"]).orderBy("ord", "name")


def roots_of(table: DataFrame) -> list[tuple[str, str]]:
    """The list that searches take."""
    return [(r.name, r.path) for r in table.orderBy("ord", "name").collect()]  # a user's roots


def load_access(spark: SparkSession, path: str, catalog: DataFrame | None = None) -> DataFrame:
    """(file, open_count, last_opened), one row a file; with a catalog only of files that it has."""
    rows = _load(spark, path, ACCESS).filter("file is not null")
    rows = rows.groupBy("file").agg(F.sum("open_count").alias("open_count"), F.max("last_opened").alias("last_opened"))
    return rows if catalog is None else rows.join(catalog.select(F.col("path").alias("file")), "file", "left_semi")


def save_bucketed(rows: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save rows as a table dealt to buckets by a key and sorted by it in each; the table.

    Two such tables with the same number of buckets are joined on their keys
    without a shuffle: catalog and tag entries by path, catalog and postings by id.
    A table of another layout is dealt to the buckets of the larger one alone.
    """
    writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)
