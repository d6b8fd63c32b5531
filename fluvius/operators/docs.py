"""Document operators: ordered lookup, upsert difference, nulls left out, search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_in_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of ``ids`` in their order (column pos); unknown ones are left out.  The list is a request, so it is broadcast."""
    want = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"_want {df.schema[key].dataType.simpleString()}, pos int")
    return df.join(F.broadcast(want), F.col(key) == F.col("_want")).drop("_want").orderBy("pos")


def upsert_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, action (inserted, modified, matched, deleted) for a sync of ``old`` to ``new``."""
    fields = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("_a"), F.struct(*fields).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*fields).alias("_new"))
    action = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "matched").otherwise("modified")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), action.alias("action"))


#: Digests of identifiers are taken over buckets of this width, then over the buckets.
BUCKET = 1024


def ids_key(df: DataFrame, key: str) -> DataFrame:
    """One row, ids_sha: digest of the distinct whole-number identifiers.

    A tree of digests, so that no task holds all of them: identifiers fall into buckets of
    BUCKET neighbours, the sorted list of each bucket is digested, and so are neighbouring
    buckets with their digests, until the root is left.  No identifiers have the digest of
    an empty text.
    """
    level = df.select(F.col(key).cast("long").alias("at")).filter("at IS NOT NULL").distinct().withColumn("sha", F.col("at").cast("string"))
    for _ in range(7):  # 1024 ** 6.4 is the range of a long
        level = level.groupBy(F.floor(F.col("at") / BUCKET).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "sha"))).alias("l"))
        level = level.select(F.col("up").alias("at"), F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["at"].cast("string"), x["sha"])), ","), 256).alias("sha"))
    both = level.agg(F.array_join(F.array_sort(F.collect_list("sha")), ","))  # two at most: numbers below and from 0
    return both.select(F.sha2(F.col(both.columns[0]), 256).alias("ids_sha"))
