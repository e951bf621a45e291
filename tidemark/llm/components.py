"""Connected components by alternating large-star and small-star rounds, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of that node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    # the node itself goes with its own smallest neighbour: the row where v is m
    return tied.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def roots(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: longs, no self-loops) but the roots themselves; root: the smallest node reachable.

    Each round's edges are written to the shared folder, so no round depends on what an executor holds. The number
    of rounds grows with the logarithm of the longest chain.
    """
    now = stored(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (seen.n, seen.h)
        now = stored(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
