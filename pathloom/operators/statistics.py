"""What a benchmark reports of its samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, least, median, p95, p99, most) of a column: quantiles are samples, the smallest that so many in a hundred don't exceed. Nulls don't count.

    Equal values are counted before the shuffle, so a group is as large as it has different values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    counted = counted.withColumn("__upto", F.sum("__n").over(group.orderBy("__v"))).withColumn("__all", F.sum("__n").over(group))
    at = lambda p: F.min(F.when(F.col("__upto") >= p * F.col("__all"), F.col("__v")))
    return counted.groupBy(*by).agg(F.sum("__n").alias("n"), F.min("__v").alias("least"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("__v").alias("most"))
