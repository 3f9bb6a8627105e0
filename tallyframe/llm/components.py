"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the labels of linked nodes (a, b) made equal.

    In each round every label goes over to its smallest neighbour, and links are reduced to those
    between different labels. Labels are hashes, so their order along any path is random and the
    number of rounds grows with the logarithm of the number of labels. A label with many links only
    takes part in a minimum that is aggregated before the shuffle.
    """

    def between(edges: DataFrame, names: DataFrame) -> DataFrame:
        left, right = names.select(F.col("node").alias("a"), F.col("label").alias("la")), names.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        named = edges.join(left, "a").join(right, "b").where("la != lb")
        return written(named.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")

    edges = between(links.select("a", "b"), labels)
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "parents")
        moved = labels.join(parents.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
        labels = written(moved.select("node", F.coalesce("new", "label").alias("label")), "labels")
        edges = between(edges, parents)
    return labels
