"""Connected components of an edge table, by alternating large-star and small-star steps.

Nodes are of any orderable type. Each step is a grouped minimum and a join; edges go through the shared
folder between steps, so lost executors cost no more than a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

STEPS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) with u's least neighbour, itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node on an edge; root is the least node of its component. ``edges`` has columns a, b."""
    state = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    now, was = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(STEPS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = saved(small.where("u <> v").distinct())
        # One pass tells whether the edges are those of the step before: their number and a hash of them all.
        got, now = new.agg(*state).first(), new
        if got == was:
            break
        was = got
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
