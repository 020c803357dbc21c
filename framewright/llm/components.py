"""Connected components of link tables, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the not larger and the node itself) to its least neighbour."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b: long): comp is the least node reachable. Each round is written to the shared folder.

    Aggregations are minima only, so a node with very many links is no burden. No edges give an empty table.
    """
    now = scratch.written(edges.filter("a <> b").select("a", "b").distinct(), "links")
    sign = None
    while True:
        before, now = now, scratch.written(_star(_star(now, True), False), "links")
        scratch.discard(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == sign:
            break
        sign = found
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())
