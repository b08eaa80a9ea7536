"""Connected components by alternating large and small stars; only counts and checksums reach the driver.

A root with very many members is a hot key: its minimum is pre-aggregated, and the joins that hand it out shuffle for
themselves, so that adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Scratch, apart


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node with an edge (a, b); root is the smallest node reachable. Self-edges are ignored."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = scratch.save(edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("c"), "m")
        # Large star: larger neighbours move to the smallest of a node and its neighbours.
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.least("m", "c").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("c"), "m")
        met = large.join(least, F.col("u") == F.col("c"))
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        then, now = now, scratch.save(small)
        scratch.drop(then)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if new == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._scratch_path = now._scratch_path
            return out
        mark = new
