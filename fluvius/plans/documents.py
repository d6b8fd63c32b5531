"""Document store and data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import docs as D
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 13 <> 0)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'deleted' WHEN o.s = n.s AND o.p = n.p THEN 'matched' ELSE 'modified' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def upsert_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = o.filter("id % 13 <> 0").withColumn("s", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("s")))
    return D.upsert_diff(o.filter("id % 11 <> 0"), new, "id")


@query("""SELECT 'orders without customer' AS name, count(*) AS failed, count(*) = 0 AS ok FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'lines without part', count(*), count(*) = 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 'negative price', count(*) FILTER (WHERE o_totalprice < 0), count(*) FILTER (WHERE o_totalprice < 0) = 0 FROM orders
 UNION ALL SELECT 'repeated key', count(*) - count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders""")
def integrity_checks(spark, d):
    o = table(spark, d, "orders")
    rep = o.agg((F.count("*") - F.countDistinct("o_orderkey")).alias("failed")).select(F.lit("repeated key").alias("name"), "failed", (F.col("failed") == 0).alias("ok"))
    parts = [C.missing_refs("orders without customer", o, "o_custkey", table(spark, d, "customer"), "c_custkey"), C.missing_refs("lines without part", table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part"), "p_partkey"), C.check_row("negative price", o, F.col("o_totalprice") < 0), rep]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH b AS (SELECT l_suppkey AS k, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1), a AS (SELECT l_suppkey AS k, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem WHERE l_linenumber < 7 GROUP BY 1)
 SELECT coalesce(b.k, a.k) AS k, b.v AS before, a.v AS after, abs(coalesce(b.v, 0) - coalesce(a.v, 0)) AS off, abs(coalesce(b.v, 0) - coalesce(a.v, 0)) <= 0.5 AS ok FROM b FULL JOIN a ON a.k = b.k""")
def conservation_check(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("double").alias("v"), "l_linenumber")
    return C.conserved(rows, rows.filter("l_linenumber < 7"), "k", "v", 0.5)


_TREE = "SELECT DISTINCT c_custkey AS num, CAST(c_custkey AS VARCHAR) AS sha FROM customer WHERE c_acctbal > 9000"
for _ in range(7):
    _TREE = f"SELECT CAST(floor(num / 1024.0) AS BIGINT) AS num, sha256(string_agg(num || ':' || sha, ',' ORDER BY num)) AS sha FROM ({_TREE}) GROUP BY 1"


@query(f"SELECT sha256(coalesce(string_agg(sha, ',' ORDER BY sha), '')) AS ids_sha FROM ({_TREE})")
def subset_key(spark, d):
    return D.ids_key(table(spark, d, "customer").filter("c_acctbal > 9000"), "c_custkey")


@query("""SELECT s.s_suppkey AS key, s.s_name AS name, r.r_name AS root, coalesce(l.best, -1) AS best FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
 LEFT JOIN (SELECT l_suppkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) l ON l.l_suppkey = s.s_suppkey""")
def document_joins(spark, d):
    best = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("best"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(best, "s_suppkey", "left")
    return rows.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("r_name").alias("root"), F.coalesce("best", F.lit(-1.0)).alias("best"))


@query("""WITH c AS (SELECT p_brand AS k, p_type AS name, count(*) AS n, sum(p_retailprice) AS w FROM part GROUP BY 1, 2), s AS (SELECT *, round(n * 1.0 / sum(n) OVER (PARTITION BY k), 9) AS share FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY share DESC, name) AS rn, lead(share) OVER (PARTITION BY k ORDER BY share DESC, name) AS second FROM s)
 SELECT k, name, share, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.3 AND share - coalesce(second, 0) >= 0.01 THEN 'medium' WHEN share >= 0.2 THEN 'low' ELSE 'none' END AS tier, round(share - coalesce(second, 0), 9) AS margin FROM r WHERE rn = 1""")
def match_tiers(spark, d):
    from ..operators.tiers import classify

    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    total = counts.groupBy("k").agg(F.sum("n").alias("all"))
    shares = counts.join(total, "k").select("k", "name", F.round(F.col("n") / F.col("all"), 9).alias("share"))
    return classify(shares, "k", "name", "share", high=0.8, medium=(0.3, 0.01), low=0.2)
