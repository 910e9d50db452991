"""Connected components of an edge table by alternating large-star and small-star rounds.

Both rounds only ever send a node's edges to that node's smallest neighbour, so
the number of edges never grows; minima are aggregated partially, and a node
with very many neighbours is split by the skew join.  Each round is written to
the shared checkpoint folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked with the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).where("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b"))).where("a != b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is its smallest node.

    Self-loops and repeated edges are allowed; nulls are not linked.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")

    def state(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r.n, r.x

    before = state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    # Converged: every edge links a node with its component.
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
