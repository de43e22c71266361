"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import pin


#: A node with at least 1/HUB_SHARE of all edges is a hub.
HUB_SHARE = 1024


def _meet(edges: DataFrame, least: DataFrame, on: str, total: int) -> DataFrame:
    """edges with the m of their node, from least (on, m, n), which is stored: n edges have this node."""
    hub = F.col("n") >= max(2, -(-total // HUB_SHARE))
    marked = edges.join(F.broadcast(least.where(hub).select(on, F.col("m").alias("hub"))), on, "left")
    near = marked.where("hub is not null").withColumnRenamed("hub", "m")
    return near.unionByName(marked.where("hub is null").drop("hub").join(least.where(~hub).select(on, "m"), on).select(*near.columns))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of edges (a, b) (longs) the least node it is connected with. Nodes without an edge to another don't appear.

    Large-star hangs each node's larger neighbours under its least neighbour, small-star its smaller ones; a fixed point
    is a set of stars. The number of rounds grows with the logarithm of the longest path. Each round sums before it
    shuffles (the least neighbour is a minimum), and its edges are stored, so a lost executor costs one round. More than
    rounds of them (they do for paths of 2 ** 30 nodes) are an error: an unfinished answer is none. Edges of
    hubs, at most 2 * HUB_SHARE nodes, meet their least neighbour in a broadcast, so no task gets all edges of one.
    """
    now = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, total = None, now.count()
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pin(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = _meet(both, least, "u", total).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = pin(large.where("a > b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _meet(down, pin(low), "a", total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = pin(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        total = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise ArithmeticError(f"components aren't found after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
