"""Graph operators on a tree over customers: node k + 1 drains to (k + 1) div 2, and 0 is the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.checks import partition_faults
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


def tree(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), "c_acctbal", "c_nationkey")
    return rows.select("id", F.floor(F.col("id") / 2).cast("long").alias("next"), (F.col("id") * 37 % 101 + 1).alias("area"), "c_acctbal", F.col("c_nationkey").cast("long").alias("nation"))


_T = "WITH RECURSIVE t AS (SELECT c_custkey + 1 AS id, (c_custkey + 1) // 2 AS next, (c_custkey + 1) * 37 % 101 + 1 AS area, c_acctbal, CAST(c_nationkey AS BIGINT) AS nation FROM customer)"
_UP = f"{_T}, up AS (SELECT id, id AS pos, 1 AS n FROM t UNION ALL SELECT up.id, t.next, n + 1 FROM up JOIN t ON t.id = up.pos WHERE t.next <> 0)"


@query(f"{_T}, c AS (SELECT id FROM t WHERE id IN (3, 10) UNION SELECT t.id FROM t JOIN c ON t.next = c.id) SELECT id FROM c")
def tree_closure(spark, d):
    return G.closure(tree(spark, d), spark.createDataFrame([(3,), (10,)], "id long"))


@query(f"{_UP} SELECT id, CAST(max(n) AS BIGINT) AS depth FROM up GROUP BY id")
def tree_depth(spark, d):
    return G.depth(tree(spark, d))


@query(f"{_UP} SELECT pos AS id, CAST(sum(area) AS BIGINT) AS total FROM up JOIN t USING (id) GROUP BY pos")
def subtree_sums(spark, d):
    return G.subtree_sums(tree(spark, d), "area")


@query(f"{_UP} SELECT id, arg_min(pos, n) AS found FROM (SELECT id, pos, n FROM up WHERE pos <> id AND pos % 7 = 0) GROUP BY id UNION ALL SELECT id, NULL FROM t WHERE id NOT IN (SELECT id FROM up WHERE pos <> id AND pos % 7 = 0)")
def first_marked_ancestor(spark, d):
    return G.first_marked_below(tree(spark, d), F.col("id") % 7 == 0)


@query(f"{_UP} SELECT id, bool_or(pos % 11 = 0) AS crosses FROM up GROUP BY id")
def path_crosses_flag(spark, d):
    return G.crosses(tree(spark, d), F.col("id") % 11 == 0)


@query(f"{_UP} SELECT id, CASE WHEN m % 2 = 1 THEN 'sea' ELSE 'sink' END AS kind FROM (SELECT id, min(pos) AS m FROM up GROUP BY id)")
def terminal_kind(spark, d):
    ends = G.terminal(tree(spark, d))
    return ends.select("id", F.when(F.col("terminal") % 2 == 1, "sea").otherwise("sink").alias("kind"))


@query(f"{_T}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY next ORDER BY area DESC, id) AS rn FROM t WHERE next <> 0) WHERE rn = 1), w AS (SELECT CAST(1 AS BIGINT) AS id UNION ALL SELECT b.id FROM b JOIN w ON b.next = w.id) SELECT id FROM w")
def largest_branch_trace(spark, d):
    return G.largest_branch(tree(spark, d), 1, "area")


@query(f"{_T}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY next ORDER BY area DESC, id) AS rn FROM t WHERE next <> 0 AND id % 5 <> 0) WHERE rn = 1), w AS (SELECT CAST(1 AS BIGINT) AS id UNION ALL SELECT b.id FROM b JOIN w ON b.next = w.id) SELECT id FROM w")
def named_trace_claimed(spark, d):
    return G.largest_branch(tree(spark, d), 1, "area", claimed=F.col("id") % 5 == 0)


@query(f"{_T} SELECT id FROM t WHERE next = 0 OR (area >= 60 AND next IN (SELECT next FROM t WHERE area >= 60 AND next <> 0 GROUP BY next HAVING count(*) >= 2))")
def major_branches(spark, d):
    return G.major_mouths(tree(spark, d), "area", 60)


@query(f"{_T}, g AS (SELECT * FROM t WHERE nation IN (1, 2, 3)) SELECT id, CASE WHEN next = 0 THEN 'sea' ELSE 'flows-out' END AS kind FROM g WHERE next NOT IN (SELECT id FROM g)")
def group_roots(spark, d):
    g = tree(spark, d).filter(F.col("nation").isin(1, 2, 3))
    return g.join(g.select(F.col("id").alias("_m")), F.col("next") == F.col("_m"), "left_anti").select("id", F.when(F.col("next") == 0, "sea").otherwise("flows-out").alias("kind"))


@query("SELECT c_custkey, r_name || ' / ' || n_name AS path, 3 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ancestor_path(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(" / ", "r_name", "n_name").alias("path"), F.lit(3).alias("level"))


@query("""SELECT 'world' AS node, count(*) AS members, round(avg(c_acctbal), 6) AS mean FROM customer UNION ALL SELECT r_name, count(*), round(avg(c_acctbal), 6) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
 UNION ALL SELECT n_name, count(*), round(avg(c_acctbal), 6) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def hierarchy_rollup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.explode(F.array(F.lit("world"), "r_name", "n_name")).alias("node"), "c_acctbal").groupBy("node").agg(F.count("*").alias("members"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query("""SELECT c_custkey AS item, CASE WHEN c_custkey % 10 = 0 THEN 'overlap' ELSE 'unowned' END AS fault FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 13 = 5 AND c_custkey % 10 <> 0""")
def partition_check(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    own = ids.filter("item % 13 <> 5 OR item % 10 = 0").withColumn("owner", F.lit("a")).unionByName(ids.filter("item % 10 = 0").withColumn("owner", F.lit("b")))
    return partition_faults(own, ids, "item", "owner")


@query(f"{_T} SELECT id, CASE WHEN next = 0 THEN 0 WHEN nation % 3 <> (SELECT p.nation % 3 FROM t p WHERE p.id = t.next) THEN 0 ELSE next END AS next_kept, CASE WHEN next <> 0 AND nation % 3 <> (SELECT p.nation % 3 FROM t p WHERE p.id = t.next) THEN 'cut' END AS why FROM t")
def edge_cuts(spark, d):
    t = tree(spark, d)
    below = t.select(F.col("id").alias("_b"), (F.col("nation") % 3).alias("_root"))
    j = t.join(below, F.col("next") == F.col("_b"), "left")
    cut = (F.col("next") != 0) & (F.col("nation") % 3 != F.col("_root"))
    return j.select("id", F.when((F.col("next") == 0) | cut, 0).otherwise(F.col("next")).cast("long").alias("next_kept"), F.when(cut, "cut").alias("why"))


@query(f"{_T}, e AS (SELECT id AS a, next AS b FROM t WHERE next <> 0 AND id % 4 <> 0), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id AS n, id AS m FROM t UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a) SELECT n AS id, min(m) AS component FROM r GROUP BY n")
def components(spark, d):
    t = tree(spark, d)
    return G.components(t.filter("next <> 0 AND id % 4 <> 0").select(F.col("id").alias("a"), F.col("next").alias("b")), t)


@query(f"{_UP} SELECT id, CAST(max(n) - 1 AS INTEGER) AS level FROM up GROUP BY id")
def topo_levels(spark, d):
    t = tree(spark, d)
    return G.topo_levels(t.filter("next <> 0").select(F.col("next").alias("src"), F.col("id").alias("dst")), t)


@query(f"""{_T}, s AS (SELECT id, next, pow(1 + id % 5, 1.5) / sum(pow(1 + id % 5, 1.5)) OVER (PARTITION BY next) AS share FROM t WHERE next <> 0),
 f AS (SELECT id, CAST(1 AS DOUBLE) AS flux FROM t WHERE next = 0 UNION ALL SELECT s.id, f.flux * s.share FROM s JOIN f ON s.next = f.id) SELECT id, round(flux, 9) AS flux FROM f""")
def shares_flux(spark, d):
    t = tree(spark, d)
    e = t.filter("next <> 0").select(F.col("next").alias("src"), F.col("id").alias("dst"), (1 + F.col("id") % 5).alias("w"))
    return G.flux(G.shares(e, "w", 1.5), t).select("id", F.round("flux", 9).alias("flux"))


@query()
def stream_detect(spark, d):
    t = tree(spark, d).withColumn("key", F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), (F.col("nation") % 2).cast("string"))))
    return G.streams(t, "key", 2)


@query()
def prune_ends(spark, d):
    return G.prune_ends(tree(spark, d), F.col("area") > 50).select("id", "next")


@query(f"{_T}, x AS (SELECT id, area, max(area) OVER () AS most FROM t WHERE next = 0 OR next IN (1, 2)) SELECT id, area, CASE WHEN area = most THEN 'exit' WHEN area >= 30 THEN 'other' ELSE 'small' END AS class FROM x")
def exit_pick(spark, d):
    x = tree(spark, d).filter("next = 0 OR next IN (1, 2)")
    most = x.agg(F.max("area").alias("most"))
    return x.crossJoin(F.broadcast(most)).select("id", "area", F.when(F.col("area") == F.col("most"), "exit").when(F.col("area") >= 30, "other").otherwise("small").alias("class"))


@query(f"{_UP} SELECT id, count(*) AS reaches, CAST(sum(t2.area) AS BIGINT) AS km, round(sum(t2.c_acctbal * t2.area) / sum(t2.area), 6) AS weighted FROM up JOIN (SELECT id AS i2, area, c_acctbal FROM t) t2 ON t2.i2 = up.pos GROUP BY id")
def path_metrics(spark, d):
    t = tree(spark, d).withColumn("wx", F.col("c_acctbal") * F.col("area"))
    add = lambda a, b: a + b
    out = G.climb(t, {"reaches": F.lit(1).cast("long"), "km": F.col("area"), "wx": F.col("wx")}, {"reaches": add, "km": add, "wx": add})
    return out.select("id", "reaches", "km", F.round(F.col("wx") / F.col("km"), 6).alias("weighted"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey + 1 AS id FROM customer),
 e AS (SELECT a, b, w FROM (SELECT id AS a, 2 * id AS b, id % 7 + 1 AS w FROM n UNION ALL SELECT id, 2 * id + 1, id % 5 + 2 FROM n UNION ALL SELECT id, 3 * id, id % 3 + 3 FROM n) WHERE b IN (SELECT id FROM n) AND b % 17 <> 0 AND a % 23 <> 0),
 p AS (SELECT id, CAST(0 AS BIGINT) AS dist, id AS source FROM n WHERE id IN (1, 5) UNION SELECT b, dist + w, source FROM p JOIN e ON e.a = p.id)
 SELECT id, CAST(min(dist) AS DOUBLE) AS dist, arg_min(source, dist * 10 + source) AS source FROM p GROUP BY id""")
def shortest_paths(spark, d):
    n = tree(spark, d).select("id")
    to = lambda b, w: n.select(F.col("id").alias("a"), b.alias("b"), w.cast("double").alias("w"))
    i = F.col("id")
    e = to(2 * i, i % 7 + 1).unionByName(to(2 * i + 1, i % 5 + 2)).unionByName(to(3 * i, i % 3 + 3))
    e = e.join(n.withColumnRenamed("id", "b"), "b", "left_semi")
    return G.shortest(e, n.filter("id IN (1, 5)"), n.filter("id % 17 = 0"), n.filter("id % 23 = 0"))
