"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _pointed(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's greater neighbours point to the least of its neighbourhood. Small star: its smaller ones, and it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    ends = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return ends.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component, for every node that an edge (u, v) touches.

    Each step is written to the shared folder, which cuts lineage; steps go on until nothing changes,
    about the logarithm of the longest path.
    """
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = common.written(_pointed(_pointed(now, True), False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
