"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.session import cut

#: Edges up to which a table of a row a node is broadcast.
BROADCAST_EDGES = 500_000
#: Fewer edges a task are not worth a file of their own.
EDGES_A_TASK = 50_000


def _least(edges: DataFrame) -> DataFrame:
    """node -> least of itself and its neighbours; a plain aggregate, so a hot node is combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _with_least(edges: DataFrame, small: bool) -> DataFrame:
    """Edges beside their node's least neighbour. That table has a row a node; it is broadcast where the edges are known
    to be few, else written first, so that Spark can split a hot node's partition in the join."""
    least = _least(edges)
    return edges.join(F.broadcast(least) if small else cut(least), "u")


def connected_components(edges: DataFrame, max_rounds: int = 50, rows: int | None = None) -> DataFrame:
    """(u, v) integer edges -> (node, component): each node with the smallest node that it reaches.

    Nodes without edges don't come back. Null ends are ignored, loops only name their node, repeated edges count
    once. Each round is two aggregates and two equi-joins, and ends in the shared checkpoint folder; rounds grow with
    the logarithm of the longest chain. No neighbour list is ever collected. ``rows``: how many edges there are at most,
    where the caller knows it; small tables are then written to few files.
    """
    edges = edges.where("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long"))
    edges = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
    edges = cut(edges if rows is None else edges.coalesce(max(1, -(-rows // EDGES_A_TASK))))
    n, before = edges.count(), None
    small = n <= BROADCAST_EDGES  # no round makes more edges than there were
    few = lambda df: df.coalesce(max(1, -(-n // EDGES_A_TASK)))
    nodes = edges.where("u = v").select("u")
    edges = few(edges.where("u <> v"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, small).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        star = _with_least(large, small)
        star = star.select("u", F.col("m").alias("v")).unionByName(star.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(few(star))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
    alone = nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return few(roots.unionByName(alone).groupBy("node").agg(F.min("component").alias("component")))
