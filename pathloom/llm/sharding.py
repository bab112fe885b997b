"""Sharding by jump consistent hashing, with a gapless slot in each shard.

Native: DataFrame expressions only. The shard is a function of the key and the
number of shards alone; when a shard is appended, a key either stays or moves
to the new shard. Slots come from two levels, (shard, hash bucket) counts and a
rank within the bucket, so that no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import fresh


AT_ONCE = 64  # draws


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to shards - 1.

    Each draw is a hash of (key, number of the draw), so it doesn't depend on
    `shards`: the jumps for n and n + 1 shards are the same as long as both
    stay below n. A jump goes forward by one at least, so `shards` steps are
    enough; about their logarithm are made, and steps beyond the first 64 are
    only walked through by keys that need them.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(state["key"], i), 33)
        to = F.floor((state["next"] + 1) * F.lit(float(1 << 31)) / (draw + 1)).cast("long")
        on = state["next"] < shards
        return F.struct(
            state["key"].alias("key"),
            F.when(on, state["next"]).otherwise(state["at"]).alias("at"),
            F.when(on, to).otherwise(state["next"]).alias("next"),
        )

    start = F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, AT_ONCE))), start, step)
    if shards <= AT_ONCE:
        return walked["at"].cast("int")
    on = F.aggregate(F.sequence(F.lit(AT_ONCE + 1), F.lit(shards)), walked, step)
    return F.when(walked["next"] >= shards, walked["at"]).otherwise(on["at"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int | None = None) -> DataFrame:
    """Documents with size, text_crc32, shard, slot and grown_shard; every column of `docs` stays but those names.

    Key: doc_id; a null doc_id is one key of its own. A null text has size 1
    and the checksum of the empty text. Rows that repeat a doc_id share its
    shard and get slots of their own, ordered by doc_id, checksum and size.
    An empty table gives an empty result. buckets: of a shard, each numbered by
    one task; by default so many that a bucket has some thousand rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    made = ("size", "text_crc32", "shard", "slot", "grown_shard")
    key = F.xxhash64(F.lit("shard"), F.col("doc_id"))
    rows = docs.drop(*made).withColumns(
        {
            "size": (F.octet_length(text) + 1).cast("long"),
            "text_crc32": F.crc32(F.encode(text, "UTF-8")),
            "shard": jump_hash(key, shards),
            "grown_shard": jump_hash(key, shards + 1),
        }
    )
    buckets = buckets or max(4096, docs.count() // (shards * 8192))
    bucket, rank, ahead, n = fresh(rows, "slot_bucket", "slot_rank", "slot_ahead", "slot_rows")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    # At most shards * buckets rows, some thousandth of the input.
    held = rows.groupBy("shard", bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy("shard", bucket).orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn(rank, F.row_number().over(within))
    return ranked.join(held, ["shard", bucket]).withColumn("slot", (F.col(ahead) + F.col(rank) - 1).cast("long")).drop(bucket, rank, ahead)
