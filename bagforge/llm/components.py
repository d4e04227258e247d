"""Connected components over an edge table: minimum hooking, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def connected_components(edges: DataFrame, tag: str = "") -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows pointers to their end and keeps the edges
    between the ends. Groups are only ever reduced by min(), never gathered. An empty table gives an empty one.
    """
    e = scratch(_tidy(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))), tag)
    labels = None
    while True:
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_m")).select("node", F.least("node", "_m").alias("root"))
        up = scratch(up, tag)
        while True:
            end = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            up = scratch(up.join(end, up.root == end._n).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), tag)
            moved = up.where("moved").limit(1).count()
            up = up.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = up.select("node", F.col("root").alias("component"))
        else:
            to = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            labels = scratch(labels.join(to, labels.component == to._n, "left").select("node", F.coalesce("_r", "component").alias("component")), tag)
        a = up.select(F.col("node").alias("src"), F.col("root").alias("_a"))
        b = up.select(F.col("node").alias("dst"), F.col("root").alias("_b"))
        e = scratch(_tidy(e.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))), tag)
        if e.isEmpty():
            return labels


def _tidy(e: DataFrame) -> DataFrame:
    return e.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
