"""Connected components of a table of edges, by alternating star operations.

A large star points each neighbour above a node to the least of the node's neighbourhood; a small star does so for those below
and the node itself. Both keep components, and turns of both end in stars around the least member, after a number of turns that
grows with the logarithm of the nodes. Each is an aggregate and an equi-join; links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakern.operators.materialise import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b) but the components' least, which is what `component` holds.

    Loops, repeated edges and either direction are allowed; edges with a null are left out.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        edges = cut(_small_star(_large_star(edges)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), the component's name being its least node."""
    found = stars(edges)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
