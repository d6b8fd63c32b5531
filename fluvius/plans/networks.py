"""Networks that split and meet, over orders: each leads to its customer's next one, some also to the next but one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flows as N
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


def orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("id")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), "o_custkey")
    return rows.select("id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("n1"), F.lead("id", 2).over(w).alias("n2"))


def firsts(spark, d):
    """Each customer's first order."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderkey").cast("long")).alias("id")).select("id")


def lasts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderkey").cast("long")).alias("id")).select("id")


_O = """WITH RECURSIVE o AS (SELECT id, lag(id) OVER w AS prev, lead(id) OVER w AS n1, lead(id, 2) OVER w AS n2 FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, o_custkey FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY id))"""
_WIDE = f"""{_O}, e AS (SELECT id AS src, n1 AS dst, CAST(id * 37 % 23 + 5 AS DOUBLE) AS width, 0 AS cost, id % 10 + 1 AS length, 0 AS cut FROM o WHERE n1 IS NOT NULL
 UNION ALL SELECT id, n2, CASE WHEN id % 3 = 0 THEN 'infinity'::DOUBLE ELSE CAST(id % 19 + 8 AS DOUBLE) END, CASE WHEN id % 3 = 0 THEN id % 4 ELSE 0 END, id % 6, CAST(id % 3 = 0 AND id % 4 = 0 AS INTEGER) FROM o WHERE n2 IS NOT NULL AND id % 4 < 2),
 a AS (SELECT id, 'infinity'::DOUBLE AS width FROM o WHERE prev IS NULL UNION SELECT dst, least(a.width, e.width) FROM a JOIN e ON src = id), b AS (SELECT id, max(width) AS width FROM a GROUP BY id),
 t AS (SELECT src, dst, cost, length, cut FROM e JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE least(x.width, e.width) = y.width),
 s AS (SELECT id, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS cut, id AS source FROM o WHERE prev IS NULL UNION SELECT dst, s.cost + t.cost, s.length + t.length, s.cut + t.cut, source FROM s JOIN t ON src = id),
 f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, length, cut, source) AS rn FROM s),
 r AS (SELECT f.id, source, width, CAST(cost AS DOUBLE) AS cost, CAST(length AS DOUBLE) AS length, cut AS shortcuts FROM f JOIN b USING (id) WHERE rn = 1)"""


def _each(o, *edges):
    """The edges of each row; those of one customer stay together."""
    return o.select(F.inline(F.array(*edges))).filter("dst IS NOT NULL")


def _passages(o):
    i = F.col("id")
    free = i % 3 == 0
    on = F.struct(i.alias("src"), F.col("n1").alias("dst"), (i * 37 % 23 + 5).alias("width"), F.lit(0).cast("long").alias("cost"), (i % 10 + 1).alias("length"), F.lit(False).alias("shortcut"))
    over = F.struct(i.alias("src"), F.when(i % 4 < 2, F.col("n2")).alias("dst"), F.when(~free, i % 19 + 8).alias("width"), F.when(free, i % 4).otherwise(F.lit(0).cast("long")).alias("cost"), (i % 6).alias("length"), (free & (i % 4 == 0)).alias("shortcut"))
    return _each(o, on, over)


@query(f"{_WIDE} SELECT id, source, round(CASE WHEN width = 'infinity'::DOUBLE THEN -1 ELSE width END, 6) AS width, cost, length, shortcuts FROM r")
def widest_paths(spark, d):
    """Of the ways from a customer's first order to each of its others, the one with the greatest least width; -1 where nothing bounds it."""
    o = orders(spark, d)
    out = N.widest(_passages(o), firsts(spark, d))
    return out.withColumn("width", F.when(F.col("width") == float("inf"), F.lit(-1.0)).otherwise(F.round("width", 6)))


@query(f"""{_WIDE}, g AS (SELECT o.id, source, cost / length AS share, CASE WHEN r.id IS NULL OR length <= 0 THEN 'unreached' WHEN width < 12 THEN 'narrow' WHEN cost / length > 0.05 THEN 'connectors' WHEN length < 20 THEN 'short' END AS reason, length FROM o LEFT JOIN r USING (id) WHERE n1 IS NULL)
 SELECT id, source, length, round(CASE WHEN length > 0 THEN share ELSE 0 END, 6) AS share, reason FROM g""")
def linked_ends(spark, d):
    """How each customer's last order is linked with the first, and the gate that fails."""
    o = orders(spark, d)
    out = N.linked_ends(_passages(o), firsts(spark, d), lasts(spark, d), 12.0, 0.05, F.lit(20.0))
    return out.select("id", "source", "length", F.round("share", 6).alias("share"), "reason")


@query(f"{_O}, l AS (SELECT id, CAST(0 AS BIGINT) AS level FROM o WHERE prev IS NULL UNION SELECT e.dst, level + 1 FROM l JOIN (SELECT id AS src, n1 AS dst FROM o UNION ALL SELECT id, n2 FROM o WHERE id % 4 < 2) e ON src = id WHERE dst IS NOT NULL) SELECT id, max(level) AS level FROM l GROUP BY id")
def network_levels(spark, d):
    o = orders(spark, d)
    e = _each(o, F.struct(F.col("id").alias("src"), F.col("n1").alias("dst")), F.struct(F.col("id").alias("src"), F.expr("CASE WHEN id % 4 < 2 THEN n2 END").alias("dst")))
    return N.levels(e, o)


@query(f"""{_O}, e AS (SELECT id AS src, n1 AS dst, CASE WHEN id % 4 < 2 OR id % 5 = 0 THEN 1 / 2.1 ELSE 1 / 1.05 END AS share FROM o UNION ALL SELECT id, n2, 1 / 4.3 FROM o WHERE id % 4 < 2 UNION ALL SELECT id, prev, 1 / 3.7 FROM o WHERE id % 5 = 0),
 w AS (SELECT 0 AS k, id, CAST(1 AS DOUBLE) AS r FROM o WHERE prev IS NULL UNION ALL SELECT k + 1, dst, sum(r * share) FROM w JOIN e ON src = id WHERE k < 150 AND dst IS NOT NULL GROUP BY k + 1, dst) SELECT id, round(sum(r), 6) AS flux FROM w GROUP BY id""")
def cyclic_flux(spark, d):
    """Flux from each customer's first order, where some hand a part back to the order before."""
    o = orders(spark, d)
    i = F.col("id")
    on = F.struct(i.alias("src"), F.col("n1").alias("dst"), F.when((i % 4 < 2) | (i % 5 == 0), 1 / 2.1).otherwise(1 / 1.05).alias("share"))
    over = F.struct(i.alias("src"), F.when(i % 4 < 2, F.col("n2")).alias("dst"), F.lit(1 / 4.3).alias("share"))
    back = F.struct(i.alias("src"), F.when(i % 5 == 0, F.col("prev")).alias("dst"), F.lit(1 / 3.7).alias("share"))
    return N.solve_flux(_each(o, on, over, back), firsts(spark, d).withColumn("amount", F.lit(1.0)), least=1e-9).select("id", F.round("flux", 6).alias("flux"))
