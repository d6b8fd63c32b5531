"""Question answering over whitelisted metrics: rank, compare, fact, prefix and fuzzy search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.metrics import compare, fact, rank
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


def _places(spark, d):
    total = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(total, "c_custkey", "left").select("c_custkey", "c_name", "n_name", "c_acctbal", "spent")


_PLACES = """WITH t AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spent FROM orders GROUP BY 1),
 p AS (SELECT c_custkey, c_name, n_name, c_acctbal, spent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN t ON c_custkey = o_custkey)"""


@query(f"{_PLACES}, f AS (SELECT * FROM p WHERE c_acctbal > 1000) SELECT c_custkey, c_name, n_name, spent, (SELECT count(*) FROM f WHERE spent IS NOT NULL) AS matches FROM f ORDER BY spent DESC NULLS LAST, c_custkey LIMIT 10")
def rank_metric_filtered(spark, d):
    """Flagship: top 10 customers by spend above a balance, nulls last, with the number of matches."""
    return rank(_places(spark, d).filter("c_acctbal > 1000").drop("c_acctbal"), "spent", "c_custkey", 10)


@query(f"{_PLACES}, b AS (SELECT n_name, round(avg(c_acctbal), 6) AS v FROM p WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 4) GROUP BY 1) SELECT n_name, v, v = (SELECT max(v) FROM b) AS winner FROM b")
def compare_metric(spark, d):
    some = table(spark, d, "nation").filter("n_nationkey < 4").select("n_name")
    means = _places(spark, d).join(some, "n_name").groupBy("n_name").agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    return compare(means, "v")


@query(f"{_PLACES} SELECT c_custkey, 'spent' AS metric, spent AS value, 'USD' AS unit FROM p WHERE c_custkey = 42")
def fact_metric(spark, d):
    return fact(_places(spark, d), "c_custkey", 42, {"spent": "USD"})


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^| )12')")
def prefix_search(spark, d):
    terms = F.array(X.normalize(F.col("p_name")))
    return table(spark, d, "part").filter(F.exists(terms, lambda t: t.rlike(r"(^| )\Q12\E"))).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name, round(1.0 - CAST(levenshtein(lower(p_name), 'part 1234') AS DOUBLE) / greatest(length(p_name), 9), 6) AS confidence FROM part
 WHERE 1.0 - CAST(levenshtein(lower(p_name), 'part 1234') AS DOUBLE) / greatest(length(p_name), 9) >= 0.7 ORDER BY confidence DESC, p_partkey LIMIT 8""")
def fuzzy_search(spark, d):
    s = X.similarity(X.normalize(F.col("p_name")), F.lit("part 1234"))
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.round(s, 6).alias("confidence")).filter(s >= 0.7)
    return rows.orderBy(F.desc("confidence"), "p_partkey").limit(8)


@query("""SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice > 0 THEN 'regulated' ELSE 'free' END AS regime, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS above FROM part WHERE p_size IS NOT NULL AND (p_size > 25 OR p_retailprice < 1200)""")
def rank_filters(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").filter(size.isNotNull() & ((size > 25) | (price < 1200))).select("p_partkey", F.when((size > 25) & (price > 0), "regulated").otherwise("free").alias("regime"), F.when(price > 1000, 1).otherwise(0).alias("above"))


@query("SELECT n_nationkey, n_name || ' (' || r_name || ')' AS line, substr(sha256(n_name || '|' || r_name), 1, 12) AS version FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalogue_lines(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", F.format_string("%s (%s)", "n_name", "r_name").alias("line"), X.short_sha(F.concat_ws("|", "n_name", "r_name")).alias("version"))


#: Questions, and the numbers among 100, 1000, 10, 5 and 1.5 that each names: fixed values.
QUESTIONS = {"rivers of more than 100 km": [100], "at least 1 000 km long": [1000], "entre 10 20 km": [10], "over 50 reaches": [], "100,200 km": [100], "slope above 1,50": [1.5]}
_NAMED = ", ".join(f"({k}, {n})" for k, found in enumerate(QUESTIONS.values()) for n in found)


@query(f"""SELECT o_orderkey, CAST(k AS DOUBLE) AS k, EXISTS (SELECT 1 FROM (VALUES {_NAMED}) AS named(q, n) WHERE named.q = o_orderkey % {len(QUESTIONS)} AND named.n = k) AS ok
 FROM orders CROSS JOIN (VALUES (100), (1000), (10), (5), (1.5)) AS n(k)""")
def number_grounding(spark, d):
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("o_orderkey") % len(QUESTIONS) + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", q.alias("q"), F.explode(F.array(*[F.lit(float(x)) for x in (100, 1000, 10, 5, 1.5)])).alias("k"))
    return rows.select("o_orderkey", "k", X.grounded(F.col("q"), F.col("k")).alias("ok"))
