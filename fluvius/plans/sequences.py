"""Sequence operators over events by user, in the order (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()
ORDER = ["ts", "event_id"]


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""WITH r AS (SELECT *, row_number() OVER w - 1 AS n, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT user_id, min(n) AS run_from, max(n) + 1 AS run_to, min(event_type) AS event_type FROM g GROUP BY user_id, run""")
def runs(spark, d):
    return S.runs(events(spark, d), "user_id", ORDER, "event_type")


@query()
def runs_smoothed(spark, d):
    rows = events(spark, d).withColumn("kind", (F.col("value") > 50).cast("int"))
    return S.runs_smoothed(rows, "user_id", ORDER, "kind", 1.0, 2.0)


@query("""SELECT a.event_id, round(median(b.value), 6) AS median FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 4 AND a.n + 4 AND a.event_type = b.event_type GROUP BY a.event_id""")
def running_median(spark, d):
    return S.running_median(events(spark, d), "user_id", ORDER, "value", 4, "event_type").select("event_id", F.round("median", 6).alias("median"))


@query("""WITH r AS (SELECT user_id, value - 40 AS b, lag(value - 40) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, round(coalesce(sum(CASE WHEN a IS NULL THEN NULL WHEN a > 0 AND b > 0 THEN 1.0 WHEN a <= 0 AND b <= 0 THEN 0.0 WHEN a > 0 THEN a / (a - b) ELSE b / (b - a) END), 0), 6) AS length, max(b + 40) AS peak FROM r GROUP BY user_id""")
def exceedance_length(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("double")
    out = S.exceedance(events(spark, d).withColumn("km", n), "user_id", ORDER, "km", "value", 40.0)
    return out.select("user_id", F.round("length", 6).alias("length"), F.round("peak", 9).alias("peak"))


ORACLES["exceedance_length"] = ORACLES["exceedance_length"].replace("max(b + 40) AS peak", "round(max(b + 40), 9) AS peak")


@query("""WITH q AS (SELECT event_id, user_id, CAST(round(value * 1000) AS BIGINT) AS v FROM events), r AS (SELECT q.*, v - coalesce(lag(v) OVER w, 0) AS delta FROM q JOIN events USING (event_id) WINDOW w AS (PARTITION BY q.user_id ORDER BY ts, event_id))
 SELECT event_id, delta, v AS restored FROM r""")
def delta_roundtrip(spark, d):
    rows = events(spark, d).withColumn("v", F.round(F.col("value") * 1000).cast("long"))
    return S.undelta(S.deltas(rows, "user_id", ORDER, "v"), "user_id", ORDER).select("event_id", "delta", "restored")


ORACLES["delta_roundtrip"] = """WITH q AS (SELECT event_id, user_id, ts, CAST(round(value * 1000) AS BIGINT) AS v FROM events)
 SELECT event_id, v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta, v AS restored FROM q"""


@query("""WITH i AS (SELECT user_id, event_id AS lo, event_id + CAST(floor(value) AS BIGINT) * 3 AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, k)
 SELECT user_id, count(*) AS parts, CAST(sum(hi - lo) AS BIGINT) AS length FROM u GROUP BY user_id""")
def interval_union(spark, d):
    rows = events(spark, d).select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value") * 3).alias("hi"))
    return S.interval_union(rows, "user_id", "lo", "hi").groupBy("user_id").agg(F.count("*").alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("length"))


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c, event_id FROM events), p AS (SELECT user_id, i, CASE WHEN c <= 5 THEN i ELSE CAST(floor(i * (c - 1) / 4.0 + 0.5) AS BIGINT) END AS pick FROM (SELECT DISTINCT user_id, c FROM l) CROSS JOIN range(5) AS r(i) WHERE c > 5 OR i < c)
 SELECT p.user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS picks FROM p JOIN l ON p.user_id = l.user_id AND p.pick = l.n GROUP BY p.user_id""")
def evenly_spaced(spark, d):
    ids = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return ids.select("user_id", F.array_join(S.evenly_spaced(F.col("ids"), 5).cast("array<string>"), ",").alias("picks"))


@query("SELECT o_orderkey, n, round(o_totalprice * n / c, 6) AS x_from, round(o_totalprice * (n + 1) / c, 6) AS x_to FROM (SELECT o_orderkey, o_totalprice, greatest(CAST(round(o_totalprice / 40000) AS INTEGER), 1) AS c FROM orders) CROSS JOIN range(100) AS r(n) WHERE n < c")
def equal_windows(spark, d):
    out = table(spark, d, "orders").select("o_orderkey", F.inline(S.cut_windows(F.col("o_totalprice"), 40000.0)))
    return out.select("o_orderkey", F.col("n").cast("long").alias("n"), F.round("from", 6).alias("x_from"), F.round("to", 6).alias("x_to"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events) SELECT a.event_id, count(*) FILTER (WHERE b.us > a.us - 3600000000 * 24) AS in_day, count(*) FILTER (WHERE b.us > a.us - 3600000000 * 6) <= 3 AS allowed
 FROM e a JOIN e b ON a.user_id = b.user_id AND b.us <= a.us AND b.us > a.us - 3600000000 * 24 GROUP BY a.event_id, a.us""")
def rate_limit_sliding(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    hour = 3600 * 1_000_000
    w = Window.partitionBy("user_id").orderBy(us)
    return table(spark, d, "events").select("event_id", F.count("*").over(w.rangeBetween(-24 * hour + 1, 0)).alias("in_day"), (F.count("*").over(w.rangeBetween(-6 * hour + 1, 0)) <= 3).alias("allowed"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
 p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER b AS xa, last_value(v IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER f AS xb, first_value(v IGNORE NULLS) OVER f AS vb FROM n
 WINDOW b AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(coalesce(v, va + (vb - va) * (x - xa) / nullif(CAST(xb - xa AS DOUBLE), 0), va, vb), 6) AS filled FROM p""")
def null_interpolation(spark, d):
    x = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("double")
    rows = events(spark, d).withColumn("x", x).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return S.interpolate(rows, "user_id", "x", "v").select("event_id", F.round("filled", 6).alias("filled"))
