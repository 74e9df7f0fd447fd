"""Connected components of a graph given as edges: contract trees of least neighbours until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listing_radar.llm.storage import stage


def _roots(edges: DataFrame) -> DataFrame:
    """(node, parent) with the root of each node's tree, where every node hangs below its least neighbour if that is smaller."""
    both = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("v")))
    tree = stage(both.groupBy("node").agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("parent")), "tree")
    while True:  # pointer doubling: the depth halves each time
        up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        hop = tree.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        hop = stage(hop, "tree")
        tree = hop.select("node", "parent")
        if not hop.agg(F.max("moved")).first()[0]:
            return tree


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (u, v); the component is its least node.

    Minima are found with map-side combining, so a hub is never gathered. Each round contracts every tree to its root, which at
    least halves the nodes that still have edges, and ends in a written table. Self-loops, repeated edges and nulls are left out.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    levels = []
    while not now.isEmpty():
        roots = _roots(now)
        levels.append(roots)
        low = now.join(roots.withColumnRenamed("node", "u"), "u").select("v", F.col("parent").alias("a"))
        both = low.join(roots.withColumnRenamed("node", "v"), "v").select("a", F.col("parent").alias("b")).where("a <> b")
        now = stage(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if not levels:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    known = levels.pop().withColumnRenamed("parent", "component")
    while levels:
        below = levels.pop()
        known = below.join(known.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    return known
