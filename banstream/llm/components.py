"""Connected components of a graph whose edges are a DataFrame.

Each round hooks every node to its least neighbour, shortens the paths to the roots, and goes on with the edges
between different roots. Every node that is not a root goes, so the edges shrink at least geometrically. All of it
is grouping and joining; nothing comes to the driver but whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banstream.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b): a row (node, component) per node that has an edge; component is its least node.

    Loops, repeated edges and null ends are ignored.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("node", F.col("q").alias("p"))
        parent = materialize(parent, "parents")
        if labels is None:
            labels = parent.select("node", F.col("p").alias("component"))
        else:
            labels = labels.join(parent.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = materialize(labels, "components")
        left = materialize(
            left.join(parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
