"""Connected components over edge tables, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, stage, view


def components(edges: DataFrame) -> DataFrame:
    """(node, label), a staged table: label is the smallest node of the component. edges: (a, b), long; self-loops and nulls don't count.

    Each round hands the smallest label to all neighbours and then follows
    labels one step (pointer jumping); rounds end when no label changes. A hub's
    messages are combined before the shuffle.
    """
    both = edges.filter("a <> b")
    both = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = stage(labels, "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("to")).agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, labels["node"] == offered["to"]).select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        nearer = stage(nearer, "labels")
        jump = nearer.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = nearer.join(jump, nearer["label"] == jump["via"]).select("node", "was", F.least("label", "further").alias("label"))
        after = stage(after, "labels")
        discard(labels, nearer)
        labels = after
        if not after.filter("label <> was").limit(1).count():
            discard(both)
            return view(after, after.select("node", "label"))
