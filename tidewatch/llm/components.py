"""Connected components by alternating large and small stars, on DataFrames.

Each round is two aggregations (with map-side minima) and two joins on the edges left; its edges are written to the shared
folder and replace those of the round before, so lineage stays short and lost executors cost one round. The driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import dropped, materialised


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    moved = down.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reached) of every node that is not its own root; edges: a, b (bigint, a <> b)."""
    now = materialised(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
        if mark == seen or mark.n == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = mark, now
        now = materialised(_small(_large(before)))
        dropped(before)
