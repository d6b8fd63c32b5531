"""Cutting lineage in loops: checkpoints in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (at or _own()).rstrip("/")


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="fluvius-")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df``: what follows starts from written rows and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and reread: for loops that join a table with itself.

    A checkpoint keeps the estimated size of its plan.  A join multiplies the sizes of its
    sides, so the digits of that number double or triple each round, and after some rounds
    planning alone takes minutes.  A written table has the size of its files.
    """
    at = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Layers:
    """Rows that a loop settles round by round: each layer is written once and all are read together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.parts = spark, f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}", []

    def add(self, rows: DataFrame) -> DataFrame:
        """``rows``, written as a layer and reread."""
        self.parts.append(f"{self.at}/{len(self.parts)}")
        rows.write.parquet(self.parts[-1])
        return self.spark.read.schema(rows.schema).parquet(self.parts[-1])

    def read(self, schema) -> DataFrame:
        """All layers; none at all gives an empty table."""
        return self.spark.read.schema(schema).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], schema)


@contextlib.contextmanager
def plain_plans(spark: SparkSession):
    """No constraints are carried through checkpoints inside: in loops they double with every round."""
    key = "spark.sql.constraintPropagation.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)
