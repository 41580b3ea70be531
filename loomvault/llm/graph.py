"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node that the edges reach.

    Each round takes the least label among neighbours and then the label's own label (pointer jumping), so the number of
    rounds follows the logarithm of the longest path. Only aggregates and equi-joins over the edge list: nothing is
    collected, and a node of very high degree is combined before it is shuffled.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = stash(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        least = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stash(least.join(jump, "mid").select("node", "was", F.least("mid", "far").alias("label")), "labels")
        if new.filter("was <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
