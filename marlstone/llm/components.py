"""Connected components of links by repeated contraction.

Each round gives every vertex the least of itself and its neighbours as parent,
jumps to the parent's parent, and keeps the distinct edges between what is left.
A star is done in one round, a path of n vertices in O(log n). Every join has
stored tables on both sides, so Spark can split partitions with a hot key;
nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every vertex of edges (a, b): label is the component's least vertex."""
    edges = stored(edges.select("a", "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        jumped = stored(parent.join(above, "parent").select("node", "top"))
        if labels is None:
            labels = jumped.withColumnRenamed("top", "label")
        else:
            labels = stored(labels.join(jumped.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        left = edges.join(jumped.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a")
        right = left.join(jumped.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b")
        edges = stored(right.where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
