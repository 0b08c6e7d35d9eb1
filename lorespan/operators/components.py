"""Connected components by alternating large-star and small-star joins.

Each step is a minimum per node (pre-aggregated before its shuffle) and an
equi-join back.  The minima of the few nodes with very many edges are sent to
all tasks, so their edges stay where they are; no neighbourhood is ever
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import discard, stash


#: A node with this many edges, and with this share of all of them, is a hot one; so there are at most twice the inverse of the share.
HOT_EDGES, HOT_SHARE = 1_000_000, 1e-3


def _linked(both: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """Edges (u, v) with the minimum m of u; ``edges``: how many there are about."""
    least = max(HOT_EDGES, int(HOT_SHARE * edges))
    if edges < least:
        return both.join(low, "u").select("u", "v", "m")
    hot = F.broadcast(low.where(F.col("n") >= least).select("u", F.col("m").alias("hot")))
    marked = both.join(hot, "u", "left")
    return marked.where("hot is not null").select("u", "v", F.col("hot").alias("m")).union(marked.where("hot is null").join(low, "u").select("u", "v", "m"))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _linked(both, low, 2 * n if large else n)
    if large:  # larger neighbours move to the smallest one
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the node itself move to the smallest one
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is connected to.

    Edges with a null end, loops and repeated edges change nothing; nodes
    without an edge to another node are not in the result (they are components
    of their own).  An empty table gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = stash(now, "edges"), None
    n = now.count()
    while True:
        last, now = now, stash(_star(_star(now, True, n), False, n), "stars")
        discard(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, n = tuple(state), state[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
