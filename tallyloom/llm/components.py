"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (src > dst): each neighbour of a node moves to the smallest id the node knows."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
    joined = both.join(least, "src")
    if large:
        moved = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        moved = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select("src", F.col("m").alias("dst"))
        )
    return moved.where("src <> dst").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())


def component_ids(links: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in ``links`` (src, dst); component: its smallest id.

    Every round is checkpointed to the shared folder. The rounds end when the edges no longer
    change, which is after O(log n) of them.
    """
    edges = checkpointed(
        links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        edges = checkpointed(_star(_star(edges, True), False))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
