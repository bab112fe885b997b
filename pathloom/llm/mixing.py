"""Mixing sources to target weights with Sainte-Lague apportionment.

Native: DataFrame expressions only.

1. Targets: sources share all words by weight; a source stops at `most` times
   its size and the excess is shared again (closed form of the water level).
2. Quotas: the mix is cut into shards of blocks of equal words. Its seats go to
   the sources by highest quotients, in order, so that each shard has a whole
   number of seats of each source.
3. Selection: a source's documents lie on a line in seeded hash order. Each
   shard owns a stretch of the line in proportion to its seats there and must
   give its quota of words from it: the source's target in whole words, spread
   over the seats. Within the stretch whole passes come first; of the rest,
   blocks are taken at a seeded, even stride, and what is left below one block
   is the beginning of a block that isn't taken. A source too small for a seat
   has its whole line in one seeded shard, so that it comes to its target too.
   What a document gives is found by arithmetic on its place alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import fresh, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row a source (source, source_size) to source, rank, source_size, total, n_sources, target."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("rank", F.row_number().over(by_name)).withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"),
            "cap": (F.col("source_size") * most).cast("double"),
            "total": F.sum("source_size").over(every),
            "n_sources": F.count("*").over(every),
        }
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # With the first k sources full the level is (total - full) / open weight; the true level is its highest value.
    out = out.withColumn("level", (F.col("total") - full) / open_weight).withColumn("level", F.max("level").over(every))
    target = F.least("cap", F.col("level") * F.col("weight"))
    return out.select("source", "rank", "source_size", "total", "n_sources", target.alias("target"))


def shard_quotas(targets: DataFrame, shards: int = 64, blocks_per_shard: int = 512) -> DataFrame:
    """Integer quotas (rank, shard, seats) by highest quotients; ties go to the source that comes first."""
    seats = shards * blocks_per_shard
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    # The divisor at which all seats are given lets no source exceed this.
    most = F.floor(share * (seats + F.col("n_sources") / 2) + 0.5) + 1
    claims = targets.filter(share > 0).select("rank", "target", F.explode(F.sequence(F.lit(1).cast("long"), most.cast("long"))).alias("k"))
    order = Window.orderBy(F.desc(F.col("target") / (2 * F.col("k") - 1)), "rank")
    won = claims.withColumn("seat", F.row_number().over(order)).filter(F.col("seat") <= seats)
    shard = F.floor((F.col("seat") - 1) / blocks_per_shard).cast("int")
    return won.groupBy("rank", shard.alias("shard")).agg(F.count("*").alias("seats"))


def shard_plan(targets: DataFrame, shards: int = 64, blocks_per_shard: int = 512, seed: int = 17) -> DataFrame:
    """One row a source and shard: the stretch of the source's line that the shard owns, and what it takes of it.

    rank, source, source_size, target, shard, seats, part_from, part_to (words
    of the line), before (words taken by earlier shards), quota (words to take),
    and how: passes, then `chosen` of `blocks` blocks of `length` words, then
    `rest` words from rest_from on (from the stretch's beginning).
    """
    block = F.floor(F.col("total") / (shards * blocks_per_shard)).cast("long")
    grid = targets.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    won = shard_quotas(targets, shards, blocks_per_shard).withColumnRenamed("rank", "r").withColumnRenamed("shard", "s")
    grid = grid.join(won, (F.col("rank") == F.col("r")) & (F.col("shard") == F.col("s")), "left").drop("r", "s")
    of_source = Window.partitionBy("rank")
    grid = grid.withColumn("seats", F.coalesce("seats", F.lit(0)))
    none = F.sum("seats").over(of_source) == 0
    share = F.when(none, (F.pmod(F.xxhash64(F.lit(seed), "rank"), F.lit(shards)) == F.col("shard")).cast("long")).otherwise(F.col("seats"))
    grid = grid.withColumn("share", share)
    upto = F.sum("share").over(of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grid = grid.withColumns({"upto": upto, "all": F.sum("share").over(of_source), "want": F.round("target").cast("long")})
    edge = lambda seats: F.floor(F.col("source_size") * (seats / F.col("all"))).cast("long")
    size = F.greatest("source_size", F.lit(1))
    given = lambda words: F.round(F.col("want") * (words / size)).cast("long")
    grid = grid.withColumns({"part_from": edge(F.col("upto") - F.col("share")), "part_to": edge(F.col("upto"))})
    grid = grid.withColumns({"before": given(F.col("part_from")), "quota": given(F.col("part_to")) - given(F.col("part_from")), "words": F.greatest(F.col("part_to") - F.col("part_from"), F.lit(1))})
    grid = grid.withColumn("length", F.greatest(F.least(block, "words"), F.lit(1)))
    grid = grid.withColumns({"passes": F.floor(F.col("quota") / F.col("words")).cast("long"), "blocks": F.floor(F.col("words") / F.col("length")).cast("long")})
    part = F.col("quota") - F.col("passes") * F.col("words")
    grid = grid.withColumn("chosen", F.least(F.floor(part / F.col("length")).cast("long"), F.col("blocks")))
    grid = grid.withColumns({"turn": F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.col("blocks")), "rest": part - F.col("chosen") * F.col("length")})
    # The first block that isn't chosen, or the short one after all others.
    free = F.when(F.col("chosen") < F.col("blocks"), F.floor(F.col("turn") / F.greatest(F.col("blocks") - F.col("chosen"), F.lit(1))).cast("long")).otherwise(F.col("blocks"))
    grid = grid.withColumn("rest_from", free * F.col("length"))
    return grid.select("rank", "source", "source_size", "target", "shard", "seats", "part_from", "part_to", "before", "quota", "passes", "length", "blocks", "chosen", "turn", "rest", "rest_from")


def _taken(x: Column) -> Column:
    """Words that are taken among the first x of the source's line. plan: its stretches, by shard."""
    at = F.greatest(F.size(F.filter("plan", lambda s: s["part_from"] <= x)), F.lit(1))
    s = F.element_at("plan", at)
    x = x - s["part_from"]
    whole = F.least(F.floor(x / s["length"]).cast("long"), s["blocks"])
    upto = lambda b: F.floor((b * s["chosen"] + s["turn"]) / s["blocks"]).cast("long")
    inside = F.when(whole < s["blocks"], (x - whole * s["length"]) * (upto(whole + 1) - upto(whole))).otherwise(F.lit(0))
    rest = F.least(F.greatest(x - s["rest_from"], F.lit(0)), s["rest"])
    return s["before"] + s["passes"] * x + s["length"] * upto(whole) + inside + rest


def line_order(seed: int = 17) -> Column:
    """Place of a document on its source's line: the highest 12 bits of this, then the rest."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    shards: int = 64,
    blocks_per_shard: int = 512,
    seed: int = 17,
    buckets: int = 4096,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row a document.

    taken: words of the document in the mix, repeats counted; never over `most`
    times its size, over a source together its target in whole words, and for
    each shard its quota (see shard_plan). A null source is a source, last in
    order; a null text has no words. Without any word all targets are 0 and
    nothing is taken; an empty table gives an empty result. Rows that repeat a
    doc_id count as documents of their own. Other columns are left out; the
    result depends on rows and seed alone, not on partitions.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), line_order(seed).alias("h"))
    rows = stage(rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).cast("int")), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = shard_plan(targets, shards, blocks_per_shard, seed).groupBy("rank", "source", "source_size", "target")
    parts = ("shard", "part_from", "before", "passes", "length", "blocks", "chosen", "turn", "rest", "rest_from")
    plan = plan.agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("plan"))  # `shards` values each
    plan = plan.withColumnRenamed("source", "own").drop("rank")

    # At most sources * buckets rows.
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("own"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    line = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.withColumn("upto", F.sum("size").over(line))
    dealt = dealt.join(sums, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("b"))).drop("own", "b")
    dealt = dealt.withColumn("end", F.col("ahead") + F.col("upto")).join(plan, F.col("source").eqNullSafe(F.col("own")))
    taken = _taken(F.col("end")) - _taken(F.col("end") - F.col("size"))
    return dealt.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 17, **params) -> DataFrame:
    """The documents of the mix, with all their columns: each as many times as it is taken, the broken part by a seeded draw.

    A document of no words (null texts too) isn't part of a mix and goes. Rows
    that repeat a doc_id repeat in proportion to their own words; null ids and
    null sources are values like others. An empty table gives an empty result.
    """
    own_id, own_size, times, copy, words = fresh(docs, "mix_id", "mix_size", "mix_times", "mix_copy", "mix_words")
    mix = mix_sources(docs, seed=seed, **params).groupBy("doc_id", "size").agg((F.sum("taken") / F.count("*")).alias("taken"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    mix = mix.filter(F.col("size") > 0).select(F.col("doc_id").alias(own_id), F.col("size").alias(own_size), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias(times))
    own = docs.withColumn(words, word_count(F.col("text")))
    out = own.join(mix.filter(F.col(times) > 0), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(words) == F.col(own_size)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
