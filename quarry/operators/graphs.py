"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import checkpointed


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge to another: the least node that it reaches.

    Stars are contracted in turn (Kiveris et al., 2014): greater neighbours move to the
    least neighbour, then smaller ones, until nothing moves; the rounds grow with the
    logarithm of the longest path, and no node gathers its neighbours.
    """
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = checkpointed(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        to = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(to, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = checkpointed(moved.filter("u <> v").distinct())
        if now.count() == after.count() and now.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after
