"""Keep-first, largest share, dense identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order that ends in a unique column; nulls last.

    Done as a grouped minimum: rows are combined before the shuffle, so a key with very
    many rows does not land in one task.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


def largest_share(parts: DataFrame, key: str, owner: str, amount: str, least: float) -> DataFrame:
    """key, owner, share: the owner of the largest share of each key, null below ``least``; ties go to the lowest owner."""
    total = parts.groupBy(key).agg(F.sum(amount).alias("total"), F.min_by(owner, F.struct(-F.col(amount), F.col(owner))).alias("top"), F.max(amount).alias("most"))
    share = F.round(F.col("most") / F.col("total"), 9)
    return total.select(key, F.when(share >= least, F.col("top")).alias(owner), share.alias("share"))


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, 3, ... in the order of unique columns, without a sort in one task.

    Rows are range-partitioned and sorted, and written once, so that counts by partition
    (each row's offset) and the rows themselves see the same partitions.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row per partition, not per row
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")
