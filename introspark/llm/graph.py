"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); the root is the component's smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour. The number of
    rounds grows with the logarithm of the longest chain; every round is written, so no lineage builds up. Edge lists
    stay on the executors, and neighbours are aggregated to their minimum, never gathered.
    """
    edges = land(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = land(small.filter("u <> v").distinct(), "star-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    least = edges.groupBy("u").agg(F.min("v").alias("root"))
    return least.select(F.col("u").alias("node"), "root").unionByName(least.select(F.col("root").alias("node"), "root").distinct())
