"""Data-quality operators: profiles, integrity, conservation, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """column_name, n, uniques, nulls, least, most for numeric columns, in one pass."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    row = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), distinct(c).alias("uniques"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")).alias(f"p{k}") for k, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.col(f"p{k}") for k in range(len(columns))])))


def check_row(name: str, df: DataFrame, bad) -> DataFrame:
    """name, failed, ok: how many rows of ``df`` fail."""
    return df.agg(F.coalesce(F.count_if(bad), F.lit(0)).alias("failed")).select(F.lit(name).alias("name"), "failed", (F.col("failed") == 0).alias("ok"))


def missing_refs(name: str, child: DataFrame, key: str, parent: DataFrame, ref: str) -> DataFrame:
    """name, failed, ok: rows of ``child`` whose key is set and not in ``parent``."""
    gone = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(ref).alias("_ref")).distinct(), F.col(key) == F.col("_ref"), "left_anti")
    return gone.agg(F.count("*").alias("failed")).select(F.lit(name).alias("name"), "failed", (F.col("failed") == 0).alias("ok"))


def conserved(before: DataFrame, after: DataFrame, key: str, amount: str, tolerance: float) -> DataFrame:
    """key, before, after, off, ok for every key of either side."""
    a = before.groupBy(key).agg(F.sum(amount).alias("before"))
    b = after.groupBy(key).agg(F.sum(amount).alias("after"))
    off = F.abs(F.coalesce("before", F.lit(0.0)) - F.coalesce("after", F.lit(0.0)))
    return a.join(b, key, "full").withColumn("off", off).withColumn("ok", F.col("off") <= tolerance)


def partition_faults(members: DataFrame, root: DataFrame, item: str, owner: str) -> DataFrame:
    """item, fault: items with two owners, outside the root, or of the root and unowned."""
    owners = members.groupBy(item).agg(F.countDistinct(owner).alias("n"))
    both = owners.join(root.select(F.col(item).alias("_root")).distinct(), F.col(item) == F.col("_root"), "full")
    fault = F.when(F.col(item).isNull(), "unowned").when(F.col("_root").isNull(), "outside").when(F.col("n") > 1, "overlap")
    return both.select(F.coalesce(item, "_root").alias(item), fault.alias("fault")).filter(F.col("fault").isNotNull())
