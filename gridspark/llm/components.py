"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; the root is the least node of its component.

    Each round points every node at its least neighbour, follows two pointers, and keeps the edges
    between what is left, so the edge table shrinks by a factor each time. All state is in written
    tables; only the count of remaining edges reaches the driver. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    labels = None
    while labels is None or not both.isEmpty():
        up = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "components-up")
        far = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = materialize(up.join(far, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "components-parent")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("a").alias("root"), F.col("p").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "components-labels")
        ends = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        both = materialize(both.join(parent, "a").select("p", "b").join(ends, "b").where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "components-edges")
    return labels
