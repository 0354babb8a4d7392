"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of (u, v) with long ids; root is the smallest node reachable.

    Each round is two grouped minima and two joins, written to the shared folder. A hub's minimum
    is combined before the shuffle, and the join that spreads it has one row per node on the
    right, so AQE can split the hub. Rounds grow with the logarithm of the longest path.
    """
    canonical = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = scratch.save(canonical, "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.distinct(), "large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(now)
        scratch.drop(large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
