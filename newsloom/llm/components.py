"""Connected components of an edge table by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.session import stored


def followed(parents: DataFrame) -> DataFrame:
    """(node, up) with every chain followed to its end; each step doubles the reach."""
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("further"))
        step = stored(parents.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "jump")
        parents = step.select("node", "up")
        if step.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b, of any one ordered type) that are not themselves the root, its component's smallest node.

    A round hooks each node to its smallest neighbour, if that is smaller, follows the chains to their ends and keeps
    the edges between different ends. Every node that has an edge left is then an end; a component with edges
    loses all ends but its local minima, half of them at least. Nodes are never gathered: a hub's edges are
    reduced where they lie, and joins with it have one row per node on the other side, so that AQE can split it.
    """
    left = stored(edges.select("a", "b").where("a != b").union(edges.select("b", "a").where("a != b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        hooked = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).where("up < node")
        parents = followed(stored(hooked, "hooks"))
        if labels is None:
            labels = parents
        else:
            moved = labels.join(parents.select(F.col("node").alias("up"), F.col("up").alias("to")), "up", "left")
            labels = stored(moved.select("node", F.coalesce("to", "up").alias("up")).union(parents), "labels")
        for side in ("a", "b"):
            renamed = parents.select(F.col("node").alias(side), F.col("up").alias("to"))
            left = left.join(renamed, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        left = stored(left.select("a", "b").where("a != b").distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.withColumnRenamed("up", "root")
