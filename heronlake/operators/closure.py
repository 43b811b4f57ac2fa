"""What a set of nodes reaches along edges, and what a purge may drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.plans.scratch import drop_stored, stored

#: Rounds that are compared one by one before they become one table.
ROUNDS = 8


def reachable(roots: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(node) and (node, reads) -> all nodes that the roots reach, themselves among them; cycles are no matter.

    by: further columns of roots, such as a session; each combination is followed by itself. Only nodes reached in the
    last round are joined with the edges, so every edge is followed once for each combination; rounds are as many as
    the longest shortest path has edges. Each round is a written table. Null nodes are none.
    """
    keys = [*(by or []), "node"]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    seen = [stored(roots.select(*keys).where("node is not null").distinct(), "reach")]
    while not seen[-1].isEmpty():
        step = seen[-1].join(edges.select("node", "reads"), "node").select(*(by or []), F.col("reads").alias("node")).where("node is not null").distinct()
        for before in seen:
            step = step.join(before, keys, "left_anti")
        seen.append(stored(step, "reach"))
        if len(seen) > ROUNDS:
            whole = stored(union(seen[:-1]), "reach")
            for before in seen[:-1]:
                drop_stored(before)
            seen = [whole, seen[-1]]
    return union(seen)


def purge(named: DataFrame, edges: DataFrame, owner: str, purged: str) -> DataFrame:
    """(owner, sha256) and (node, reads) -> sha256, kept: what the purged owner reaches, and whether another does too."""
    of = lambda on: reachable(named.where(on).select(F.col("sha256").alias("node")), edges)
    mine, keep = of(F.col(owner) == purged), of(F.col(owner) != purged)
    return mine.join(keep.withColumn("kept", F.lit(True)), "node", "left").select(F.col("node").alias("sha256"), F.coalesce("kept", F.lit(False)).alias("kept"))
