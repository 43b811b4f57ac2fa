"""Connected components of an edge table by repeated grouping: large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import drop_stored, stored


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b) -> (node, component), the smallest node reachable; nodes without edges are absent.

    Each step joins nodes with a grouped minimum, so no neighbourhood is gathered in one place. Edge tables
    between rounds are written to the shared folder. Rounds grow with the logarithm of the largest component;
    beyond most_rounds it is an error.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stored(pairs, "components")
    total = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        # done when every node has one edge, to a node that has none of its own
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(now) if total is not None else None
        now = after
        if state == total:
            break
        total = state
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
