"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklake.plans.cut import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's neighbours (large: the greater ones, small: the lesser ones and itself) on the smallest of them."""
    if large:
        edges = edges.union(edges.select("b", "a"))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = edges.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of an edge (a, b) the smallest node of its component; loops alone make no node.

    Large and small stars in turn until nothing changes: a number of rounds that grows with the logarithm of the longest
    path. Each round is written to the shared folder, and only its row count and a checksum come to the driver.
    """
    before, now = None, cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        new = cut(_star(_star(now, True), False), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(now)
        now = new
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b")).distinct()
