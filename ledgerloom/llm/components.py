"""Connected components by repeated contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; null ends are ignored.

    Each round maps every node to the least of itself and its neighbours and
    contracts the edges. A star ends in one round; from the second round the
    order is by a hash of the node, so long chains shrink by a constant factor
    too. Both sides of every join are read from written tables: a hub's rows
    are then an ordinary skewed join that Spark splits.
    """
    edge = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rest = scratch.keep(edges.where("a != b").select(*edge).distinct())
    layers: list[DataFrame] = []
    while not rest.isEmpty():
        by = F.col("b") if not layers else F.xxhash64("b", F.lit(len(layers)))
        own = rest.select("a").union(rest.select("b")).select("a", F.col("a").alias("b"))
        near = rest.select("a", "b").union(rest.select("b", "a")).union(own)
        least = near.groupBy("a").agg(F.min(F.struct(by.alias("h"), "b")).getField("b").alias("up"))
        layers.append(scratch.keep(least.select(F.col("a").alias("node"), "up")))
        up = layers[-1]
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = rest.join(left, "a").join(right, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        after = scratch.keep(moved.where("a != b").select(*edge).distinct())
        scratch.drop(rest)
        rest = after
    if not layers:
        return rest.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = layers[-1].select("node", F.col("up").alias("root"))
    for layer in reversed(layers[:-1]):
        above = found.select(F.col("node").alias("up"), "root")
        found = layer.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return found
