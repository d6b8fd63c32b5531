"""Answers over metrics: rank, compare, fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank(df: DataFrame, metric: str, key: str, k: int, descending: bool = True) -> DataFrame:
    """The k best rows with the number of rows that have a value; nulls last either way, ties by key.

    The list is a heap per partition and the count one number, so neither sorts the table.
    """
    order = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    matches = df.agg(F.count(metric).alias("matches"))
    return df.orderBy(order, key).limit(k).crossJoin(F.broadcast(matches))


def compare(df: DataFrame, metric: str, best=F.max) -> DataFrame:
    """Rows with winner: every row that equals the best value."""
    top = df.agg(best(metric).alias("_best"))
    return df.crossJoin(F.broadcast(top)).withColumn("winner", F.col(metric) == F.col("_best")).drop("_best")


def fact(df: DataFrame, key: str, value, metrics: dict[str, str]) -> DataFrame:
    """key, metric, value, unit of one entity, for each whitelisted metric."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit")) for m, u in metrics.items()])
    return df.filter(F.col(key) == value).select(key, F.inline(items))
