"""Structured Streaming over event files: windowed counts with a watermark, and the sliding limit per user."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import shared_dir

LIMIT, WINDOW_S = 10, 60.0


def event_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Event files as a stream; ts as an instant."""
    schema = spark.read.parquet(path).schema
    # A pattern, since a file source takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 day", late: str = "6 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped, closed windows come out once."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("v"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.col("v").cast("double").alias("v"))


def allow(key, batches, state):
    """Keeps the last LIMIT accepted times of a user; an event is allowed if fewer lie within WINDOW_S before it."""
    times = list(state.get[0]) if state.exists else []
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "event_id"])
        ok = []
        for t in pdf["ts"].map(pd.Timestamp.timestamp):
            times = [x for x in times if x > t - WINDOW_S]
            ok.append(len(times) < LIMIT)
            if ok[-1]:
                times.append(t)
        yield pd.DataFrame({"event_id": pdf["event_id"], "allowed": ok})
    state.update((times,))


def rate_limit(events: DataFrame) -> DataFrame:
    """event_id, allowed: the sliding limit as a stateful operator; state is LIMIT times a user at most."""
    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(allow, "event_id long, allowed boolean", "times array<double>", "append", "NoTimeout")


def drain(stream: DataFrame, at: str) -> DataFrame:
    """Run a stream over what is there, to Parquet with exactly-once commits, and read the result."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
