"""Connected components of a graph, by minimum labels and pointer jumping over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for all nodes of ``edges`` (``a``, ``b`` longs).

    Each round takes the smallest label among neighbours and then the label's own label, so a path shrinks by more
    than half.  Partial minima are taken before each shuffle, so a node with many edges is no hot spot.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        told = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(told, labels.node == told.a).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        lower = written(lower, "labels")
        parents = lower.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        after = written(lower.join(parents, lower.component == parents.parent).select("node", F.least("component", "above").alias("component"), "old"), "labels")
        labels = after.select("node", "component")
        if after.where("component != old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
