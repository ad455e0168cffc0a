"""Connected components of links by contraction: no node, group or component goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

ROW_BYTES = 40


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node of its component.

    Each round points every node at its smallest neighbour, if that is smaller, and contracts the links;
    a round at least halves the nodes that still have links, so rounds grow with the logarithm.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        # b < a on each row, so only the larger end of a link can find a smaller neighbour.
        parents = cut(edges.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent")))
        near = maybe_broadcast(parents, ROW_BYTES)
        labels = cut(labels.join(near, F.col("label") == F.col("child"), "left").select("node", F.coalesce("parent", "label").alias("label")))
        for end in ("a", "b"):
            edges = edges.join(near, F.col(end) == F.col("child"), "left").withColumn(end, F.coalesce("parent", end)).select("a", "b")
        edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels
