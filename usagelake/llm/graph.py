"""Connected components by contraction, for graphs of any shape and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node of its component.

    A round lets each node step to its least neighbour, if that is less than itself, and draws the edges again
    between the places stepped to.  Every round at least halves a component's height, so few rounds are needed;
    each is a minimum per node and two joins, and no neighbour list is ever collected.
    """
    now = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not now.isEmpty():
        least = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        lone = now.select(F.col("a").alias("node")).distinct().withColumn("to", F.col("node"))
        step = keep(least.unionByName(lone).groupBy("node").agg(F.min("to").alias("to")))
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            labels = keep(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a = step.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        drawn = now.join(a, "a").join(b, "b").where("_a <> _b")
        now = keep(drawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if labels is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
