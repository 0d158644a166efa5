"""Connected components of a graph given by its edges, by contraction.

Each round points every node at its smallest smaller neighbour, follows these pointers to their roots
by doubling, and replaces the edges by those between different roots; at least half the nodes of every
component that is not yet one root go in a round. All steps are joins and partial aggregates over
tables in the shared folder: nothing is gathered, and a hot node is a skewed join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    edges: columns a and b of one orderable type; loops, nulls, repeats and either direction are allowed.
    A node without a row is its own component, as is each component's smallest node."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    left = written(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    total = None
    while not left.isEmpty():
        roots = written(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "roots")
        while True:
            up = roots.select(F.col("node").alias("component"), F.col("component").alias("above"))
            jumped = written(roots.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")), "roots")
            moved = not jumped.where("moved").isEmpty()
            roots = jumped.drop("moved")
            if not moved:
                break
        if total is None:
            total = roots
        else:
            up = roots.select(F.col("node").alias("component"), F.col("component").alias("above"))
            total = written(total.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component")).unionByName(roots), "components")
        for end in ("a", "b"):
            up = roots.select(F.col("node").alias(end), F.col("component").alias("above"))
            left = left.join(up, end, "left").withColumn(end, F.coalesce("above", end)).drop("above")
        left = written(left.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    if total is None:
        return left.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return total
