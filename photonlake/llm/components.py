"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged




def connected_components(edges: DataFrame) -> DataFrame:
    """Columns a, b (long) in; node, component (its smallest node) out, for every node with an edge to another.

    Every round is two aggregations and two joins whose long keys AQE may split; rounds grow with the
    logarithm of the longest path. An empty table gives an empty one; loops and repeated edges change nothing.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    key = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        now = staged(down.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        got = now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("k"), F.count("*").alias("n")).first()
        if key == (got.k, got.n):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        key = (got.k, got.n)
