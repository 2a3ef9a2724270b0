"""Connected components by contraction: every node joins its smallest neighbour, edges follow, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the smallest node of its component.

    A round at least halves the nodes that still have edges, and a component's smallest node never joins another.
    """
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        heads = rest.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
        step = ends.unionByName(heads).groupBy("node").agg(F.min("label").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        step = stored(step.join(up, "label").select("node", F.col("upper").alias("label")), "step")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("upper", "label").alias("label")), "labels")
        a, b = step.select(F.col("node").alias("a"), F.col("label").alias("la")), step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        rest = rest.join(a, "a").join(b, "b").filter("la <> lb")
        rest = stored(rest.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if rest.isEmpty():
            return labels
