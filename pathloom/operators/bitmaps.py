"""Posting lists as bitmaps over dense ids: intersected with bitmap_and_agg, joined with bitmap_or_agg.

A container holds the ids of one trigram in one bucket of 32768 ids: as their
places where there are few, else as a bitmap of 4 KB. Ids should be dense
(assign_ids gives such), or most buckets hold little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARSE = 1024  # places of two bytes up to which a list is smaller than a bitmap, with room to spare


def containers(rows: DataFrame, sparse: int = SPARSE) -> DataFrame:
    """(trigram, bucket, n, places, bits) of postings (trigram, id): either places, in order, or bits; the other is null."""
    bucket, place = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    # at most the 32768 places of a bucket
    held = rows.groupBy("trigram", bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"), F.collect_set(place.cast("smallint")).alias("places"))
    few = F.col("n") <= sparse
    held = held.withColumn("n", F.bitmap_count("bits"))
    return held.select("trigram", "bucket", "n", F.when(few, F.array_sort("places")).alias("places"), F.when(~few, F.col("bits")).alias("bits"))


def places(bits: str) -> Column:
    """The places of a bitmap's ones, in order; bytes without any are passed over."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(bits), i, F.lit(1))), 16, 10).cast("int")
    used = F.filter(F.transform(F.sequence(F.lit(1), F.octet_length(bits)), lambda i: F.struct(i.alias("i"), byte(i).alias("b"))), lambda x: x["b"] != 0)
    ones = lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.call_function("shiftright", x["b"], k).bitwiseAND(1) == 1, (x["i"] - 1) * 8 + k)), lambda p: p.isNotNull())
    return F.flatten(F.transform(used, ones))


def _ids(rows: DataFrame) -> DataFrame:
    """id of (bucket, places)."""
    return rows.select("bucket", F.explode("places").alias("place")).select(((F.col("bucket") - 1) * 32768 + F.col("place") + 1).cast("long").alias("id"))


def intersect(lists: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """Ids that have all of the trigrams: bucket by bucket, so no list is held whole."""
    wanted = lists.filter(F.col("trigram").isin(*trigrams))
    met = wanted.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"), F.count("bits").alias("dense"), F.collect_list("places").alias("lists"))
    met = met.filter(F.col("n") == len(trigrams))
    # the lists that are there narrow each other first, then the bitmap takes what is left
    few = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    in_bits = F.filter("few", lambda p: F.call_function("shiftright", byte(p), (p % 8).cast("int")).bitwiseAND(1) == 1)
    met = met.withColumn("few", few)
    found = F.when(F.col("dense") == 0, F.col("few").cast("array<int>")).when(F.size("lists") == 0, places("bits")).otherwise(in_bits.cast("array<int>"))
    return _ids(met.select("bucket", found.alias("places")))


def union(lists: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """Ids that have any of them."""
    wanted = lists.filter(F.col("trigram").isin(*trigrams))
    dense = wanted.filter("bits is not null").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).select("bucket", places("bits").alias("places"))
    few = wanted.filter("places is not null").select("bucket", F.col("places").cast("array<int>").alias("places"))
    return _ids(dense.unionByName(few)).distinct()


def counts(lists: DataFrame) -> DataFrame:
    """(trigram, n): how many ids have it."""
    return lists.groupBy("trigram").agg(F.sum("n").alias("n"))


def size(lists: DataFrame) -> DataFrame:
    """One row: containers, ids, bytes held as places and as bitmaps."""
    return lists.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("ids"),
        F.coalesce(F.sum(F.size("places") * 2), F.lit(0)).cast("long").alias("place_bytes"),
        F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).cast("long").alias("bitmap_bytes"),
    )
