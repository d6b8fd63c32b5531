"""Projection, joins, aggregation, windows, ordering and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


@query("""SELECT c_custkey, upper(c_name) AS name, round(c_acctbal / 10, 4) AS scaled, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
 nullif(trim(c_mktsegment), 'BUILDING') AS segment FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_acctbal IS NOT NULL""")
def project_filter(spark, d):
    bal = F.col("c_acctbal")
    band = F.when(bal < 0, "debt").when(bal < 5000, "low").otherwise("high")
    return table(spark, d, "customer").filter(F.col("c_nationkey").isin(1, 3, 5) & bal.isNotNull()).select("c_custkey", F.upper("c_name").alias("name"), F.round(bal / 10, 4).alias("scaled"), band.alias("band"), F.nullif(F.trim("c_mktsegment"), F.lit("BUILDING")).alias("segment"))


@query("""SELECT a.o_orderkey, CAST(a.o_totalprice IS DISTINCT FROM b.v AS INTEGER) AS differs, CAST(abs(a.o_totalprice - b.v) > 0.01 * greatest(abs(a.o_totalprice), 1) AS INTEGER) AS beyond
 FROM orders a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 1.02 ELSE o_totalprice END AS v FROM orders) b USING (o_orderkey)""")
def tolerant_compare(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = a.withColumn("v", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.02).otherwise(F.col("o_totalprice"))).drop("o_totalprice")
    off = F.abs(F.col("o_totalprice") - F.col("v")) > 0.01 * F.greatest(F.abs("o_totalprice"), F.lit(1))
    return a.join(b, "o_orderkey").select("o_orderkey", (~F.col("o_totalprice").eqNullSafe(F.col("v"))).cast("int").alias("differs"), off.cast("int").alias("beyond"))


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, l.lines FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
 LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""")
def left_chain_enrich(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", "lines")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_orphans(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_pairs(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_name").alias(f"{x}_name"), F.col("n_regionkey").alias(f"{x}_r"), F.col("n_nationkey").alias(f"{x}_k")) for x in "ab")
    return a.join(b, (F.col("a_r") == F.col("b_r")) & (F.col("a_k") < F.col("b_k"))).select("a_name", "b_name")


@query("SELECT s_suppkey, round(s_acctbal - (SELECT avg(s_acctbal) FROM supplier), 4) AS off_mean, (SELECT count(*) FROM nation) AS nations FROM supplier")
def cross_one_row(spark, d):
    s = table(spark, d, "supplier")
    one = s.agg(F.avg("s_acctbal").alias("mean")).crossJoin(table(spark, d, "nation").agg(F.count("*").alias("nations")))
    return s.crossJoin(F.broadcast(one)).select("s_suppkey", F.round(F.col("s_acctbal") - F.col("mean"), 4).alias("off_mean"), "nations")


@query("""SELECT l.l_orderkey, l.l_linenumber, CASE WHEN e.e = 0 THEN 'from' ELSE 'to' END AS side, CASE WHEN e.e = 0 THEN l.l_partkey ELSE l.l_suppkey END AS node
 FROM lineitem l CROSS JOIN (VALUES (0), (1)) AS e(e)""")
def lateral_ends(spark, d):
    ends = F.array(F.struct(F.lit("from").alias("side"), F.col("l_partkey").alias("node")), F.struct(F.lit("to").alias("side"), F.col("l_suppkey").alias("node")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(ends))


@query("""WITH s AS (SELECT l_partkey AS k, s_nationkey AS owner, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 t AS (SELECT *, round(q / sum(q) OVER (PARTITION BY k), 9) AS share FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY share DESC, owner) AS rn FROM t)
 SELECT k, CASE WHEN share >= 0.3 THEN owner END AS owner, share FROM r WHERE rn = 1""")
def largest_share_assign(spark, d):
    from ..operators.assign import largest_share

    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    parts = sold.groupBy(F.col("l_partkey").alias("k"), F.col("s_nationkey").alias("owner")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return largest_share(parts, "k", "owner", "q", 0.3)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS taxed, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS price,
 min(l_quantity) AS least, max(l_quantity) AS most, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def filtered_aggs(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return (
        table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_tax") > 0.04, 1).otherwise(0)).alias("taxed"), F.sum(p.cast("decimal(18,4)")).cast("double").alias("price"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.sum(p * q) / F.sum(q), 4).alias("weighted"))
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_all(spark, d):
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL ORDER BY ALL", orders=table(spark, d, "orders"))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having_min(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("total")).filter("n >= 12")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) - count(DISTINCT l_orderkey) AS repeats FROM lineitem GROUP BY l_suppkey")
def count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), (F.count("*") - F.countDistinct("l_orderkey")).alias("repeats"))


@query("""SELECT o_custkey, max(o_totalprice) AS best, min(CASE WHEN rt = 1 THEN o_orderkey END) AS best_order, min(CASE WHEN rl = 1 THEN o_orderkey END) AS least_order FROM (
 SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rl FROM orders) GROUP BY o_custkey""")
def arg_extrema(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("best"),
        F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("best_order"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("least_order"),
    )


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS first_keys, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders i WHERE i.o_custkey = s.o_custkey)) AS priorities
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) s WHERE rn <= 10 GROUP BY o_custkey""")
def ordered_list(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    first = o.withColumn("rn", rank).filter("rn <= 10").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))).alias("l"))
    kinds = o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    return first.select("o_custkey", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("first_keys")).join(kinds, "o_custkey")


@query("SELECT user_id, bool_or(value > 90) AS any_high, bool_and(value > 1) AS all_over, any_value(user_id) AS some FROM events GROUP BY user_id")
def bool_aggs(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 90).alias("any_high"), F.bool_and(F.col("value") > 1).alias("all_over"), F.min("user_id").alias("some"))


@query("SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def quantiles(spark, d):
    v = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(v(0.5).alias("med"), v(0.1).alias("p10"), v(0.95).alias("p95"))


@query("""SELECT l_suppkey, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS a, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS n, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS r FROM lineitem GROUP BY l_suppkey""")
def cond_pivot(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2))
    return out.toDF("l_suppkey", "a", "n", "r")


@query("""SELECT * FROM (SELECT 'c_acctbal' AS column_name, count(*) AS n, count(DISTINCT c_acctbal) AS uniques, CAST(sum(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(min(c_acctbal) AS DOUBLE) AS least, CAST(max(c_acctbal) AS DOUBLE) AS most FROM customer
 UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey), CAST(sum(CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END) AS BIGINT), CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE) FROM customer)""")
def profile_table(spark, d):
    from ..operators.checks import profile

    return profile(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


@query("""WITH s AS (SELECT r_name, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT r_name, round(100 * v / sum(v) OVER (), 6) AS share FROM s""")
def share_of_total(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.sum("c_acctbal").alias("v"))
    return sums.crossJoin(sums.agg(F.sum("v").alias("all"))).select("r_name", F.round(100 * F.col("v") / F.col("all"), 6).alias("share"))


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id NULLS LAST, source NULLS LAST) AS rn FROM documents) WHERE rn = 1""")
def dedup_first(spark, d):
    from ..operators.assign import keep_first

    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return keep_first(docs, ["h"], ["doc_id", "source"]).drop("h")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def topk_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rn").cast("long").alias("rn"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_type, p_partkey) AS id FROM part")
def surrogate_id(spark, d):
    from ..operators.assign import dense_ids

    return dense_ids(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type", "p_partkey"], "id").select("p_partkey", "id")


@query("SELECT o_custkey, o_orderkey, CAST(o_custkey AS VARCHAR) || '-' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), 3, '0') AS part_id FROM orders")
def part_numbers(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat_ws("-", F.col("o_custkey").cast("string"), F.lpad(n.cast("string"), 3, "0")).alias("part_id"))


@query("""SELECT kind, id, name FROM (SELECT * FROM (SELECT 's' AS kind, s_suppkey AS id, s_name AS name FROM supplier ORDER BY length(s_name), s_name, s_suppkey LIMIT 8) UNION ALL SELECT * FROM (SELECT 'c', c_custkey, c_name FROM customer ORDER BY length(c_name), c_name, c_custkey LIMIT 8))
 ORDER BY length(name), name, kind, id LIMIT 8""")
def merged_topk(spark, d):
    def first(t, kind, id_, name):
        return table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(name).alias("name")).orderBy(F.length("name"), "name", "id").limit(8)

    both = first("supplier", "s", "s_suppkey", "s_name").unionByName(first("customer", "c", "c_custkey", "c_name"))
    return both.orderBy(F.length("name"), "name", "kind", "id").limit(8)


@query("SELECT n.n_nationkey, n.n_name, p.pos FROM (VALUES (7, 0), (3, 1), (99, 2), (12, 3)) AS p(id, pos) JOIN nation n ON n.n_nationkey = p.id")
def ordered_lookup(spark, d):
    from ..operators.docs import lookup_in_order

    return lookup_in_order(table(spark, d, "nation"), "n_nationkey", [7, 3, 99, 12]).select("n_nationkey", "n_name", "pos")


@query("SELECT 'region' AS kind, CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation")
def union_tagged(spark, d):
    r = table(spark, d, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent"))
    return r.unionByName(n, allowMissingColumns=True)


@query("SELECT n_nationkey AS u, n_regionkey AS v FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation")
def symmetric_pairs(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("v")).union(n.select("n_regionkey", "n_nationkey"))


@query("SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(rich, "id", "left_anti")


@query("""SELECT coalesce(r_name, '*') AS r_name, coalesce(c_mktsegment, '*') AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def cube_counts(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n")).select(F.coalesce("r_name", F.lit("*")).alias("r_name"), F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), "n")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 3))) AS DOUBLE) AS exact FROM lineitem GROUP BY 1, 2")
def decimal_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,3)")).cast("double").alias("exact"))


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def order_limit(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").orderBy(F.asc_nulls_last("c_mktsegment"), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25)


@query("""SELECT o.o_orderkey, p.d AS period FROM orders o JOIN (VALUES (DATE '1994-01-01', DATE '1994-03-01', 'a'), (DATE '1995-06-01', DATE '1995-07-01', 'b')) AS p(f, t, d) ON CAST(o.o_orderdate AS DATE) >= p.f AND CAST(o.o_orderdate AS DATE) < p.t""")
def range_join(spark, d):
    periods = spark.sql("SELECT * FROM VALUES (DATE '1994-01-01', DATE '1994-03-01', 'a'), (DATE '1995-06-01', DATE '1995-07-01', 'b') AS p(f, t, period)")
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").join(F.broadcast(periods), (day >= F.col("f")) & (day < F.col("t"))).select("o_orderkey", "period")


@query("SELECT p_partkey, p_size FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = p_size)")
def exists_two_columns(spark, d):
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("q"))
    part = table(spark, d, "part").select("p_partkey", "p_size")
    return part.withColumn("q", F.col("p_size").cast("double")).join(sold, ["p_partkey", "q"], "left_semi").select("p_partkey", "p_size")
