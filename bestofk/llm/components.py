"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bestofk.session import materialise


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the smallest node of the component; only nodes with an edge appear.

    Each half round points neighbours at the smallest node seen from their common neighbour and is written to the shared folder. The number of rounds
    grows with the logarithm of the longest path. Minima are aggregates with partial sums, and the join back to the edges of a hub
    has both sides freshly shuffled, so a hub may hold any part of all edges.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    previous = None
    for _ in range(max_rounds):
        around = both(state)
        smallest = materialise(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "minima")
        large = around.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large-star")
        # Small star: a node's smaller neighbours, and the node itself, point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = materialise(least, "minima")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        state = materialise(small.where("a <> b").distinct(), "small-star")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == previous:
            break
        previous = mark
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
