"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import materialise

#: Edges of a graph up to which any star fits a task; beyond, a star of over HOT_STAR edges is hot. Of those there are
#: at most 2 / HOT_STAR of all edges, so that their least nodes can be broadcast.
SMALL, HOT_STAR = 1_000_000, 5_000


def with_least(edges: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    """edges (a, b) with m of least (a, m, k): the edges of hot centres stay where they are, the others are shuffled."""
    if small:
        return edges.join(least.select("a", "m"), "a")
    hot = F.broadcast(least.where(F.col("k") > HOT_STAR).select("a", "m"))
    return edges.join(hot, "a").unionByName(edges.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("k") <= HOT_STAR).select("a", "m"), "a"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of all nodes of edges (a, b): root is the least node of the component. Self-loops are ignored.

    Each round makes the trees lower; a graph of n nodes takes about log n rounds."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = (now.count(),)
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("k"))
        large = with_least(both, least, state[0] <= SMALL).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = with_least(large, least, state[0] <= SMALL).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        state = found
    raise RuntimeError(f"components not found in {rounds} rounds")
