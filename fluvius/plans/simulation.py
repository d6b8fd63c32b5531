"""Simulation operators: hydraulics, oxygen, mixing, paths, uncertainty, admissible load, lakes, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hydro as H
from ..functions.numbers import steps
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()
KEYS = ("l_orderkey", "l_linenumber")


def reaches(spark, d):
    return table(spark, d, "lineitem").select(*KEYS, F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("grad"), (F.col("l_tax") * 100 + 10).alias("t"), (F.col("l_extendedprice") / 1000).alias("bod"))


_R = "r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount * 100 AS grad, l_tax * 100 + 10 AS t, l_extendedprice / 1000 AS bod FROM lineitem)"
_W = f"{_R}, w AS (SELECT *, 5.0 * pow(q, 0.5) AS w, greatest(grad / 1000, 0.0002) AS s FROM r), h AS (SELECT *, pow(0.035 * q / (w * sqrt(s)), 0.6) AS h FROM w), v AS (SELECT *, q / (w * h) AS v FROM h)"
_KA = "CASE WHEN h < 0.61 THEN 5.32 * pow(v, 0.67) / pow(h, 1.85) WHEN h > 3.45 * pow(v, 2.5) THEN 3.93 * pow(v, 0.5) / pow(h, 1.5) ELSE 5.026 * v / pow(h, 1.67) END"


def channel(spark, d):
    return reaches(spark, d).withColumn("c", H.hydraulics(F.col("q"), F.col("grad"))).select("*", "c.*").drop("c")


@query(f"WITH {_W} SELECT l_orderkey, l_linenumber, round(w, 6) AS w, round(h, 6) AS h, round(v, 6) AS v, round(1000 / v / 86400, 6) AS days FROM v")
def hydraulics(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return channel(spark, d).select(*KEYS, r("w"), r("h"), r("v"), F.round(1000 / F.col("v") / 86400, 6).alias("days"))


@query(f"WITH {_W} SELECT l_orderkey, l_linenumber, round({_KA} * pow(1.024, t - 20), 6) AS ka FROM v")
def reaeration(spark, d):
    return channel(spark, d).select(*KEYS, F.round(H.at_temperature(H.reaeration(F.col("v"), F.col("h")), H.KR_THETA, F.col("t")), 6).alias("ka"))


@query(f"WITH {_R} SELECT l_orderkey, l_linenumber, round(exp(-139.34411 + 1.575701e5 / (t + 273.15) - 6.642308e7 / pow(t + 273.15, 2) + 1.2438e10 / pow(t + 273.15, 3) - 8.621949e11 / pow(t + 273.15, 4)) * (1 - 0.0001148 * (q * 10)), 6) AS cs FROM r")
def do_saturation(spark, d):
    return reaches(spark, d).select(*KEYS, F.round(H.do_saturation(F.col("t"), F.col("q") * 10), 6).alias("cs"))


@query(f"WITH {_W}, k AS (SELECT *, {_KA} AS ka FROM v) SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(ka - 0.2) < 1e-6 THEN (0.2 * 2 * bod + 1) * exp(-0.4) ELSE 0.2 * bod / (ka - 0.2) * (exp(-0.4) - exp(-ka * 2)) + 1 * exp(-ka * 2) END, 6) AS deficit FROM k")
def streeter_phelps(spark, d):
    ka = H.reaeration(F.col("v"), F.col("h"))
    rows = channel(spark, d).withColumn("ka", ka)
    return rows.select(*KEYS, F.round(H.deficit(F.col("bod"), F.lit(1.0), F.lit(H.KD), F.col("ka"), F.lit(2.0)), 6).alias("deficit"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) AS n, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS load FROM lineitem),
 f AS (SELECT k, n, q, 0.1 + load / q AS c FROM p WHERE n = 1 UNION ALL SELECT p.k, p.n, greatest(f.q, p.q), (f.c * f.q + greatest(p.q - f.q, 0) * 0.1) / greatest(f.q + greatest(p.q - f.q, 0), 1e-12) + p.load / p.q FROM f JOIN p ON p.k = f.k AND p.n = f.n + 1)
 SELECT k, n, round(c, 9) AS c FROM f""")
def mix_path(spark, d):
    rows = table(spark, d, "lineitem")
    path = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("q"), F.col("l_tax").cast("double").alias("load"))))
    folded = rows.groupBy(F.col("l_orderkey").alias("k")).agg(path.alias("p")).withColumn("c", H.path_fold(F.col("p"), 0.1))
    return folded.select("k", F.posexplode("c").alias("pos", "v")).select("k", (F.col("pos") + 1).cast("long").alias("n"), F.round("v", 9).alias("c"))


@query(f"""WITH {_R}, g AS (SELECT *, kd, mn FROM r CROSS JOIN (VALUES (0.05), (0.2), (0.5)) AS a(kd) CROSS JOIN (VALUES (0.03), (0.04), (0.05)) AS b(mn)), h AS (SELECT *, 5.0 * pow(q, 0.5) AS w FROM g),
 x AS (SELECT l_orderkey, l_linenumber, kd, mn, CASE WHEN grad = 0 THEN NULL ELSE bod * exp(-kd * (w * pow(mn * q / (w * sqrt(greatest(grad / 1000, 0.0002))), 0.6) / q * 1000 / 86.4)) END AS out FROM h)
 SELECT l_orderkey, l_linenumber, CASE WHEN min(coalesce(out, 1e300)) = 1e300 THEN NULL ELSE round(min(coalesce(out, 1e300)), 6) END AS least, CASE WHEN count(out) < count(*) THEN NULL ELSE round(max(out), 6) END AS most, round(max(CASE WHEN kd = 0.2 AND mn = 0.04 THEN out END), 6) AS central FROM x GROUP BY 1, 2""")
def uncertainty_grid(spark, d):
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("kd"), F.lit(m).alias("mn")) for k in (0.05, 0.2, 0.5) for m in (0.03, 0.04, 0.05)])).alias("g")
    rows = reaches(spark, d).select("*", grid).select("*", "g.*")
    w = 5.0 * F.sqrt("q")
    h = F.pow(F.col("mn") * F.col("q") / (w * F.sqrt(F.greatest(F.col("grad") / 1000, F.lit(0.0002)))), 0.6)
    rows = rows.withColumn("out", F.when(F.col("grad") != 0, F.col("bod") * F.exp(-F.col("kd") * (w * h / F.col("q") * 1000 / 86.4))))
    out = rows.groupBy(*KEYS).agg(F.min("out").alias("least"), F.when(F.count("out") == F.count("*"), F.max("out")).alias("most"), F.max(F.when((F.col("kd") == 0.2) & (F.col("mn") == 0.04), F.col("out"))).alias("central"))
    return out.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("least", "most", "central")])


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount * 10 AS base, l_discount * 10 + l_tax * 5 AS run FROM lineitem), s AS (SELECT *, run - base AS slope FROM a)
 SELECT k, CASE WHEN max(base) > 0.9 THEN 0.0 ELSE round(min(CASE WHEN slope > 0 THEN (0.9 - base) / slope END), 6) END AS admissible, CASE WHEN max(base) > 0.9 THEN 'base' ELSE 'load' END AS cause FROM s GROUP BY k""")
def admissible_load(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 10).alias("base"), (F.col("l_discount") * 10 + F.col("l_tax") * 5).alias("run"))
    slope = F.col("run") - F.col("base")
    room = F.min(F.when(slope > 0, (0.9 - F.col("base")) / slope))
    over = F.max("base") > 0.9
    return rows.groupBy("k").agg(F.when(over, 0.0).otherwise(F.round(room, 6)).alias("admissible"), F.when(over, "base").otherwise("load").alias("cause"))


@query(f"WITH {_R} SELECT l_orderkey, l_linenumber, round(1.55 * pow(bod / (1 + sqrt(q / 50)), 0.82), 6) AS tp, CASE WHEN 1.55 * pow(bod / (1 + sqrt(q / 50)), 0.82) < 10 THEN 'oligotrophic' WHEN 1.55 * pow(bod / (1 + sqrt(q / 50)), 0.82) < 35 THEN 'mesotrophic' ELSE 'eutrophic' END AS class FROM r")
def lake_tp(spark, d):
    tp = H.lake_phosphorus(F.col("bod"), F.col("q") / 50)
    return reaches(spark, d).select(*KEYS, F.round(tp, 6).alias("tp"), steps(tp, [(10, "oligotrophic"), (35, "mesotrophic")], "eutrophic").alias("class"))


@query("""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v, count(DISTINCT event_type) AS types FROM events GROUP BY 1, 2), f AS (SELECT user_id, min(day) AS today FROM x GROUP BY 1)
 SELECT f.user_id, round(max(CASE WHEN day = today THEN v END), 6) AS today_value, count(*) FILTER (WHERE day > today) AS following, CASE WHEN min(types) < 1 THEN NULL ELSE round(avg(v), 6) END AS mean FROM f JOIN x USING (user_id) GROUP BY f.user_id""")
def scenario_shape(spark, d):
    x = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.countDistinct("event_type").alias("types"))
    f = x.groupBy("user_id").agg(F.min("day").alias("today"))
    return x.join(f, "user_id").groupBy("user_id").agg(F.round(F.max(F.when(F.col("day") == F.col("today"), F.col("v"))), 6).alias("today_value"), F.count_if(F.col("day") > F.col("today")).alias("following"), F.when(F.min("types") >= 1, F.round(F.avg("v"), 6)).alias("mean"))


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share FROM lineitem) SELECT k, n, round(sum(share) OVER (PARTITION BY k ORDER BY n, share ROWS UNBOUNDED PRECEDING), 9) AS cumulative FROM s")
def network_shares(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("n", "share")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity")
    share = F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("k"))
    return rows.withColumn("share", share).select("k", "n", F.round(F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("cumulative"))
