"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableloom.session import cut_lineage

JUMPS = 3


def _flatten(parent: DataFrame) -> DataFrame:
    """Let every pointer (node, label) jump to the end of its chain, a power of the distance each time."""
    while True:
        up = parent.select(F.col("node").alias("__n"), F.col("label").alias("__up"))
        far = parent.withColumn("__old", F.col("label"))
        for _ in range(JUMPS):
            # A root points to itself, so every label is a node. Hot labels are split by the skew join.
            far = far.join(up, F.col("label") == F.col("__n")).select("node", F.col("__up").alias("label"), F.col("label").alias("__old"))
        # Where the last jump went nowhere, the pointer had reached its root.
        moved = cut_lineage(far.select("node", "label", (F.col("label") < F.col("__old")).alias("moved")))
        parent = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return parent


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); the label is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, flattens the chains by jumping and shrinks
    the graph to the roots, so the number of rounds grows with the logarithm of its size. An edge from
    a node to itself brings in a lone node.
    """
    graph = cut_lineage(_ordered(edges))
    nodes = graph.select(F.col("a").alias("node")).unionByName(graph.select(F.col("b").alias("node"))).distinct()
    rounds = []
    graph = graph.where("a <> b")
    while not graph.isEmpty():
        both = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            graph.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooked = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label"))
        roots = _flatten(hooked)
        rounds.append(roots)
        la = roots.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = roots.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        graph = cut_lineage(_ordered(
            graph.join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))))
    result = nodes.withColumn("label", F.col("node"))
    for roots in rounds:
        step = roots.select(F.col("node").alias("__n"), F.col("label").alias("__up"))
        result = result.join(step, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__up", "label").alias("label"))
    return result
