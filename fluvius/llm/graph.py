"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; what a step leaves is written to the shared
folder, so lineage stays short.  No links or labels are gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(both: DataFrame, large: bool) -> DataFrame:
    """``both``: links in both directions; large: neighbours above a node go to its least neighbour, small: those below."""
    side = both if large else both.filter(F.col("b") < F.col("a"))
    least = side.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    if large:
        moved = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = side.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links (a, b) -> (node, component): the least node reachable, for every node that has a link to another."""
    now = scratch.cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True)
        small = _star(large.unionByName(large.select(F.col("b").alias("a"), F.col("a").alias("b"))), False)
        k += 1
        now = scratch.cut(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if state == seen:
            break
        state = seen
    # Stable: every node points at its least reachable one.
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
