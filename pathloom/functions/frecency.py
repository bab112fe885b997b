"""Frecency: how often and how lately a file was opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Age in hours below which a weight holds, and the weight beyond.
AGE_WEIGHTS = ((1, 4.0), (24, 2.0), (168, 1.5), (720, 1.0))
OLD_WEIGHT = 0.5


def score(open_count: Column, last_opened: Column, now: int) -> Column:
    """ln(1 + opens) times a weight by age; 0 without opens. A time to come counts as just now."""
    weight = F.lit(OLD_WEIGHT)
    for hours, value in reversed(AGE_WEIGHTS):
        weight = F.when(now - last_opened < hours * 3600, F.lit(value)).otherwise(weight)
    return F.when(open_count > 0, F.log1p(open_count.cast("double")) * weight).otherwise(F.lit(0.0))


def roll_up(opens: DataFrame) -> DataFrame:
    """Open log (file, ts in epoch seconds) to file, open_count, last_opened."""
    return opens.groupBy("file").agg(F.count("*").alias("open_count"), F.max("ts").alias("last_opened"))
