"""Scalar text functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.iterate import settle
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()
#: Keys kept in one row while types are paired.
RUN = 256

_SQL_BARE = "lower(strip_accents(text))"


@query(f"SELECT doc_id, trim(regexp_replace({_SQL_BARE}, '\\s+', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_SQL_BARE}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, trim(regexp_replace({_SQL_BARE}, '[^a-z0-9°]+', ' ', 'g')) AS k FROM documents")
def name_key(spark, d):
    return table(spark, d, "documents").select("doc_id", X.name_key(F.col("text")).alias("k"))


@query("SELECT token, count(*) AS n FROM (SELECT regexp_extract(text, '^\\s*(\\S+)', 1) AS token FROM documents WHERE trim(text) <> '') WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 30")
def token_freq(spark, d):
    first = F.regexp_extract("text", r"^\s*(\S+)", 1)
    return table(spark, d, "documents").select(first.alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(30)


@query("SELECT page_id, substr(sha256(url), 1, 12) AS version, sha256(coalesce(html, '')) AS content FROM pages")
def sha_key(spark, d):
    return table(spark, d, "pages").select("page_id", X.short_sha(F.col("url")).alias("version"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("content"))


@query("SELECT p_partkey, list_aggregate(list_distinct(list_sort([lower(p_name), regexp_replace(lower(p_name), '^part ', '')])), 'string_agg', '|') AS variants, lower(p_name) = lower(trim(p_brand)) AS same FROM part")
def name_variants(spark, d):
    n = F.lower("p_name")
    variants = F.array_join(F.array_sort(F.array_distinct(F.array(n, F.regexp_replace(n, "^part ", "")))), "|")
    return table(spark, d, "part").select("p_partkey", variants.alias("variants"), (n == F.lower(F.trim("p_brand"))).alias("same"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN greatest(length(a.p_type), length(b.p_type)) = 0 THEN 1.0 ELSE round(1 - CAST(levenshtein(a.p_type, b.p_type) AS DOUBLE) / greatest(length(a.p_type), length(b.p_type)), 6) END AS s FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def name_similarity(spark, d):
    """Each two types of a group are compared once, whatever the number of parts that have them."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size").filter("p_brand IS NOT NULL AND p_size IS NOT NULL AND p_partkey IS NOT NULL")
    types = settle(p.select("p_brand", "p_size", "p_type").distinct().withColumn("type", F.monotonically_increasing_id()))
    one, two = (types.select("p_brand", "p_size", F.col("p_type").alias(f"t{k}"), F.col("type").alias(f"type{k}")) for k in "12")
    pairs = one.join(two, ["p_brand", "p_size"]).filter("type1 <= type2").select("type1", "type2", F.round(X.similarity(F.col("t1"), F.col("t2")), 6).alias("s"))
    same = (types.p_brand == p.p_brand) & (types.p_size == p.p_size) & types.p_type.eqNullSafe(p.p_type)
    # Keys of a type in runs, so that a pair of types is a row for each two runs until its keys are paired.
    parts = p.join(types, same).select("type", "p_partkey", F.floor(F.row_number().over(Window.partitionBy("type").orderBy("p_partkey")) / RUN).alias("run"))
    parts = settle(parts.groupBy("type", "run").agg(F.collect_list("p_partkey").alias("keys")))
    left, right = (parts.select(F.col("type").alias(f"type{k}"), F.col("run").alias(f"run{k}"), F.col("keys").alias(f"keys{k}")) for k in "12")
    # Few small rows become many: they are dealt out by number, as their size would leave them in one task.
    both = pairs.join(left, "type1").join(right, "type2").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "type1", "type2", "run1", "run2")
    both = both.select("type1", "type2", "s", "keys2", F.explode("keys1").alias("k1")).select("type1", "type2", "s", "k1", F.explode("keys2").alias("k2"))
    both = both.filter("k1 < k2 OR (k2 < k1 AND type1 <> type2)")
    return both.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "s")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS ok FROM events")
def json_contract(spark, d):
    from pyspark.sql import types as T

    from ..sources.tables import check_json

    schema = T.StructType([T.StructField("k", T.LongType(), False)])
    return check_json(table(spark, d, "events"), "props", schema).select("event_id", F.col("parsed.k").alias("k"), "ok")


@query("SELECT p_partkey, round(p_retailprice * 0.621371, 6) AS mi, round(CAST(p_size AS DOUBLE) * 3.28084, 6) AS ft, CASE WHEN p_size IN (0, -999) THEN NULL ELSE p_size END AS year, floor(p_retailprice / 250) AS cell, ceil(p_size / 7.0) AS parts FROM part")
def unit_math(spark, d):
    from ..functions.numbers import convert, sentinel_null

    return table(spark, d, "part").select(
        "p_partkey", F.round(convert(F.col("p_retailprice"), "km", "mi"), 6).alias("mi"), F.round(convert(F.col("p_size"), "m", "ft"), 6).alias("ft"),
        sentinel_null(F.col("p_size")).alias("year"), F.floor(F.col("p_retailprice") / 250).cast("double").alias("cell"), F.ceil(F.col("p_size") / 7.0).cast("double").alias("parts"),
    )
