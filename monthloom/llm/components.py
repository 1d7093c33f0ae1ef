"""Connected components by alternating large-star and small-star steps.

Both steps replace edges by edges to the smallest neighbour, so they shrink
chains and fan stars in without ever listing a node's neighbours: the smallest
neighbour is an aggregate combined on the map side, and the edges meet it in a
join that splits hot nodes.  The same aggregate tells whether anything is left
to do, and only nodes with several smaller neighbours need the join of the
small-star step.  Every step is written to the shared folder, and its counts
are taken while it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from monthloom.session import written

MOST_ROUNDS = 60
BROADCAST_NODES = 500_000  # pairs of nodes that are broadcast to the edges; beyond, both are joined by node


def _counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """The written table, and how many of its rows meet each condition; a repeated task may count twice."""
    seen = Observation()
    table = written(df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()]), name)
    return table, seen.get


def _short(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_NODES else table


def _neighbours(edges: DataFrame) -> tuple[DataFrame, dict]:
    """(u, m): the smallest neighbour of every node that has a smaller one; how many are not yet leaves of a star."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    down = F.col("v") < F.col("u")
    nodes = both.groupBy("u").agg(
        F.min("v").alias("m"), F.max(F.when(down, F.col("v"))).alias("most"), F.max(~down).alias("up")).filter("m < u")
    return _counted(nodes, "neighbours", n=F.lit(1), loose=F.col("up") | (F.col("most") > F.col("m")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them; edges go from u down to v."""
    several = F.col("most") > F.col("m")
    nodes, seen = _counted(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "least", n=several)
    moved = nodes.select("u", F.col("m").alias("v"))
    if not seen["n"]:
        return moved
    hubs = _short(nodes.filter(several).select("u", "m"), seen["n"])
    lowered = edges.join(hubs, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(moved.union(lowered.distinct()), "edges")


def _large_star(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood, the node itself included.

    Edges go from u down to v; a node without smaller neighbours keeps its own,
    so the edges of a hub find no partner in the join.
    """
    least = _short(nodes.select(F.col("u").alias("v"), "m"), n)
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots; the root is the smallest node it can reach.

    Raises if the edges are not stable after ``MOST_ROUNDS``.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    edges = _small_star(edges)
    for _ in range(MOST_ROUNDS):
        nodes, seen = _neighbours(edges)
        if not seen["loose"]:
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("root"))
        edges = _small_star(_large_star(edges, nodes, seen["n"]))
    raise RuntimeError(f"edges are not stable after {MOST_ROUNDS} rounds")
