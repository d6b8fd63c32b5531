"""Streaming queries, drained over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as W
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


@query("""WITH c AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS v FROM events GROUP BY 1, 2)
 SELECT CAST(day AS VARCHAR) AS day, event_type, n, v FROM c WHERE CAST(day + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")
def stream_window_counts(spark, d):
    """Daily windows that the watermark has closed."""
    out = W.drain(W.window_counts(W.event_stream(spark, f"{d}/events.parquet")), W.scratch(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "v")


@query()
def stream_rate_limit(spark, d):
    return W.drain(W.rate_limit(W.event_stream(spark, f"{d}/events.parquet")), W.scratch(spark))
