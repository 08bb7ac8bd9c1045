"""Connected components by alternating large-star and small-star rounds.

Each round is a handful of equi joins over edge rows, so no component, however large, meets in one task: minima are
pre-aggregated before they are shuffled, and the tables that are joined are read back from the shared folder, which
lets adaptive execution split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: for every node on an edge the smallest node that it reaches.

    Direction, repeats, loops and null ends of edges don't matter; a node whose only edges are loops has no row.
    """
    known = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stage(known.distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = stage(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stage(moved.unionByName(low2.withColumnRenamed("m", "v")).distinct(), "edges")
        for used in (now, low, large, low2):
            drop_staged(used)
        now, before, state = following, state, _state(following)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: two sums that are made on the executors."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
