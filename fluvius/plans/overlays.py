"""Polygon overlay and merged lines: rectangles and segments whose places follow from customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import overlay as O
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()
CELL = 8.0


def boxes(spark, d):
    """A rectangle a customer, in its nation's plane; every third belongs to the second layer."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), (k % 3 == 0).cast("int").alias("layer"), k.alias("poly"), (k * 7919 % 97).alias("x"), (k * 7907 % 89).alias("y"), (k % 11 + 2).alias("w"), (k % 7 + 2).alias("h"))
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), (F.col("x") + a * F.col("w")).alias("x"), (F.col("y") + b * F.col("h")).alias("y")) for i, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    points = rows.select("grp", "layer", "poly", F.explode(corners).alias("p")).select("grp", "layer", "poly", F.lit(0).alias("ring"), "p.seq", "p.x", "p.y")
    return O.ring_edges(points, ["grp", "layer", "poly"])


_CELLS = """
WITH t AS (SELECT CAST(c_nationkey AS BIGINT) AS grp, CAST(c_custkey % 3 = 0 AS INT) AS layer, c_custkey AS poly, c_custkey * 7919 % 97 AS x, c_custkey * 7907 % 89 AS y, c_custkey % 11 + 2 AS w, c_custkey % 7 + 2 AS h FROM customer),
u AS (SELECT grp, layer, x + i AS cx, y + j AS cy FROM t, unnest(range(w)) AS a(i), unnest(range(h)) AS b(j)),
c AS (SELECT grp, cx, cy, count(*) FILTER (layer = 0) AS a, count(*) FILTER (layer = 1) AS b FROM u GROUP BY ALL)"""
_WHERE = {"union": "true", "intersection": "a > 0 AND b > 0", "difference": "a > 0 AND b = 0", "overlap": "a + b > 1"}


def _by_cells(rule):
    """Area and outline length by counting unit cells and their sides without a neighbour."""
    return f"""{_CELLS}, k AS (SELECT * FROM c WHERE {_WHERE[rule]})
    SELECT grp, CAST(count(*) AS DOUBLE) AS area, CAST(sum((SELECT 4 - count(*) FROM k n WHERE n.grp = k.grp AND abs(n.cx - k.cx) + abs(n.cy - k.cy) = 1)) AS DOUBLE) AS length FROM k GROUP BY grp"""


def _measured(spark, d, rule):
    return O.measure(O.outline(O.sides(boxes(spark, d), CELL), rule))


@query(_by_cells("union"))
def polygon_union(spark, d):
    return _measured(spark, d, "union")


@query(_by_cells("intersection"))
def polygon_intersection(spark, d):
    return _measured(spark, d, "intersection")


@query(_by_cells("difference"))
def polygon_difference(spark, d):
    return _measured(spark, d, "difference")


@query(f"""{_CELLS}, k AS (SELECT grp, cx, cy FROM c) SELECT grp, CAST(count(*) AS DOUBLE) AS area FROM k GROUP BY grp""")
def polygon_rings_area(spark, d):
    """The union stitched into rings, and measured again from these."""
    ring = O.rings(O.outline(O.sides(boxes(spark, d), CELL), "union"))
    return O.measure(O.ring_edges(ring, ["grp"])).select("grp", "area")


_SEGMENTS = """
WITH RECURSIVE s AS (SELECT c_custkey AS id, c_custkey AS a, CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 9 ELSE c_custkey + 1 END AS b FROM customer WHERE c_custkey % 10 <> 4 OR c_custkey % 20 > 10
  UNION ALL SELECT 1000000000 + c_custkey, c_custkey, c_custkey * 7 % 5000 FROM customer WHERE c_custkey % 13 = 0),
e AS (SELECT id, a AS v FROM s UNION ALL SELECT id, b FROM s),
two AS (SELECT v, min(id) AS p, max(id) AS q FROM e GROUP BY v HAVING count(*) = 2),
j AS (SELECT p, q FROM two WHERE p <> q UNION SELECT q, p FROM two WHERE p <> q),
w AS (SELECT id, id AS r FROM s UNION SELECT w.id, j.q FROM w JOIN j ON j.p = w.r)"""


@query(f"""{_SEGMENTS}, c AS (SELECT id, min(r) AS chain FROM w GROUP BY id), o AS (SELECT chain, count(*) AS n FROM c GROUP BY chain),
k AS (SELECT chain, count(*) AS joints FROM two JOIN c ON c.id = two.p GROUP BY chain)
SELECT chain, n, coalesce(joints, 0) = n AS closed FROM o LEFT JOIN k USING (chain)""")
def merged_lines(spark, d):
    """Segments between customers merged into maximal lines; a line is closed where it has as many joints as segments."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer")
    around = rows.filter((k % 10 != 4) | (k % 20 > 10)).select(k.alias("id"), k.alias("a"), F.when(k % 10 == 9, k - 9).otherwise(k + 1).alias("b"))
    across = rows.filter(k % 13 == 0).select((k + 1000000000).alias("id"), k.alias("a"), (k * 7 % 5000).alias("b"))
    return C.merge_lines(around.unionByName(across)).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.first("closed").alias("closed"))
