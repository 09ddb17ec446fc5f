"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b): the smallest node that it can reach.

    Each round hooks every root to its smallest neighbour, shortens the resulting trees by pointer doubling until each
    node points to its root, and contracts the edges; the number of rounds grows with the logarithm of the longest
    path. Edges with a null end and loops are left out. Partial aggregates and splittable joins carry nodes with very
    many edges.
    """
    rest = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    rest = materialize(rest, "edges")
    labels = materialize(rest.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not rest.isEmpty():
        parent = materialize(rest.groupBy("hi").agg(F.min("lo").alias("up")), "parents")
        while True:
            upper = broadcast_if_small(parent.select(F.col("hi").alias("up"), F.col("up").alias("upper")))
            shorter = materialize(parent.join(upper, "up", "left").select("hi", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), "parents")
            parent = shorter.select("hi", "up")
            if shorter.filter("moved").isEmpty():
                break
        to = broadcast_if_small(parent)
        labels = materialize(labels.join(to, labels["component"] == to["hi"], "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        for end in ("hi", "lo"):
            other = "lo" if end == "hi" else "hi"
            roots = to.select(F.col("hi").alias("_n"), F.col("up").alias("_r"))
            rest = rest.join(roots, rest[end] == F.col("_n"), "left").select(F.coalesce("_r", end).alias(end), other)
        rest = materialize(rest.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    return labels
