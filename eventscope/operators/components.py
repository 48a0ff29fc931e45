"""Connected components of an edge table by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.sources.storage import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so paths shorten by half; rounds end when no label changes.  Labels are written between rounds.
    Edges with a null end are ignored; loops and repeated edges change nothing.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        moved = materialize(lower.join(jump, "component", "left").select("node", "old", F.least("component", "up").alias("component")), "cc-labels")
        labels = moved.select("node", "component")
        if moved.filter("component < old").isEmpty():
            return labels
