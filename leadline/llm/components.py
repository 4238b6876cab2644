"""Connected components of a large graph by rounds of joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select("a", "b", "m")
    moved = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a <> b").distinct()


def star_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b) as stars: every node a of a component has one edge to its smallest node b.

    Rounds of large-star and small-star (Kiveris et al., 2014); each is written to the shared folder, and two aggregates of
    the edges tell whether a round changed anything. A node of very many edges is an ordinary aggregate and a join, which
    adaptive execution splits.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == known:
            return edges
        known = state
        edges = stage(_small_star(_large_star(edges)), "links")


def component_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, component_id) for the nodes that have links: the smallest node and the smallest `first` of the component.

    nodes: node, first.
    """
    stars = star_forest(edges)
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    members = members.union(members.select(F.col("root").alias("node"), "root").distinct())
    named = members.join(nodes.select("node", "first"), "node")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return members.join(least, "root").select("node", "root", "component_id")
