"""Spatial operators over points (embedding[0], embedding[1])."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import graph as G
from ..operators import spatial as S
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()
R = 0.02


def points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), "label")


_P = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"


def _sides(p):
    return p.select(F.col("id").alias("ida"), F.col("x").alias("xa"), F.col("y").alias("ya")), p.select(F.col("id").alias("idb"), F.col("x").alias("xb"), F.col("y").alias("yb"))


@query(f"WITH {_P} SELECT a.id AS ida, b.id AS idb, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dist FROM p a JOIN p b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {R}")
def cell_distance_join(spark, d):
    return S.distance_join(*_sides(points(spark, d)), R).filter("ida < idb").select("ida", "idb", F.round("dist", 9).alias("dist"))


_NEAR = f"WITH {_P}, n AS (SELECT a.id AS ida, b.id AS idb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1)"


@query(f"{_NEAR} SELECT ida, idb, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY ida ORDER BY dist, idb) AS rn FROM n WHERE dist <= 0.05) WHERE rn = 1")
def nearest_in_radius(spark, d):
    p = points(spark, d)
    out = S.nearest(_sides(p.filter("label % 2 = 0"))[0], _sides(p.filter("label % 2 = 1"))[1], 0.05)
    return out.select("ida", "idb", F.round("dist", 9).alias("dist"))


@query(f"{_NEAR} SELECT ida, idb, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY ida ORDER BY dist, idb) AS rn FROM n) WHERE rn = 1")
def global_nearest(spark, d):
    p = points(spark, d)
    out = S.nearest_anywhere(_sides(p.filter("label % 2 = 0"))[0], _sides(p.filter("label % 2 = 1"))[1], 0.05, 100.0)
    return out.select("ida", "idb", F.round("dist", 9).alias("dist"))


@query(f"WITH {_P}, e AS (SELECT a.id AS ida, b.id AS idb FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {R / 4}), c AS (WITH RECURSIVE r AS (SELECT id AS n, id AS m FROM p UNION SELECT r.n, e.idb FROM r JOIN e ON r.m = e.ida) SELECT n AS id, min(m) AS cluster FROM r GROUP BY n) SELECT id, cluster FROM c")
def snap_clusters(spark, d):
    p = points(spark, d)
    return G.components(S.snap_links(p, R / 4), p).withColumnRenamed("component", "cluster")


def _box(spark):
    """Edges of a rectangle with a rectangular hole."""
    rings = [[(-0.5, -0.3), (0.4, -0.3), (0.4, 0.6), (-0.5, 0.6)], [(0.1, 0.0), (0.2, 0.0), (0.2, 0.2), (0.1, 0.2)]]
    rows = [("box", *a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1])]
    return spark.createDataFrame(rows, "poly string, x0 double, y0 double, x1 double, y1 double")


@query(f"WITH {_P} SELECT id, 'box' AS poly FROM p WHERE x > -0.5 AND x <= 0.4 AND y >= -0.3 AND y < 0.6 AND NOT (x > 0.1 AND x <= 0.2 AND y >= 0.0 AND y < 0.2)")
def point_in_polygon(spark, d):
    return S.point_in_polygon(points(spark, d).select("id", "x", "y"), _box(spark), 0.1)


def segments(spark, d):
    """A segment from each point to that of the next id."""
    p = points(spark, d).select("id", "x", "y")
    q = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return p.join(q, "id").select("id", F.lit(0).alias("seg"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def _share(x0, x1, y0, y1) -> str:
    """SQL: the share of a segment inside a rectangle, by the parameters at its sides."""
    axis = lambda c, lo, hi, pick: f"{pick}(({lo} - {c}0) / ({c}1 - {c}0), ({hi} - {c}0) / ({c}1 - {c}0))"
    last = f"least(1.0, {axis('x', x0, x1, 'greatest')}, {axis('y', y0, y1, 'greatest')})"
    first = f"greatest(0.0, {axis('x', x0, x1, 'least')}, {axis('y', y0, y1, 'least')})"
    return f"greatest(0.0, {last} - {first})"


@query(f"""WITH {_P}, s AS (SELECT a.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON b.id = a.id + 1),
 c AS (SELECT id, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, {_share(-0.5, 0.4, -0.3, 0.6)} - {_share(0.1, 0.2, 0.0, 0.2)} AS share FROM s)
 SELECT id, round(share * len, 6) AS inside, round((1 - share) * len, 6) AS outside, share > 0 AS meets FROM c""")
def line_clip(spark, d):
    s = segments(spark, d).withColumn("len", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))
    parts = S.clip_lines(s, _box(spark), 0.1).groupBy("id", "seg").agg(F.sum(F.col("hi") - F.col("lo")).alias("share"))
    share = F.coalesce("share", F.lit(0.0))
    return s.join(parts, ["id", "seg"], "left").select("id", F.round(share * F.col("len"), 6).alias("inside"), F.round((1 - share) * F.col("len"), 6).alias("outside"), (share > 0).alias("meets"))


def _foot(a, b) -> str:
    t = f"greatest(0.0, least(1.0, ((q.x - {a}.x) * ({b}.x - {a}.x) + (q.y - {a}.y) * ({b}.y - {a}.y)) / (pow({b}.x - {a}.x, 2) + pow({b}.y - {a}.y, 2))))"
    return f"{t} AS t{a}, sqrt(pow(q.x - {a}.x - {t} * ({b}.x - {a}.x), 2) + pow(q.y - {a}.y - {t} * ({b}.y - {a}.y), 2)) AS d{a}, sqrt(pow({b}.x - {a}.x, 2) + pow({b}.y - {a}.y, 2)) AS l{a}"


@query(f"""WITH {_P}, f AS (SELECT a.id, {_foot('a', 'b')}, {_foot('b', 'c')} FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = a.id + 2 JOIN p q ON q.id = a.id + 3)
 SELECT id, round(least(da, db), 6) AS dist, round((CASE WHEN da <= db THEN ta * la ELSE la + tb * lb END) / (la + lb), 6) AS share FROM f""")
def line_locate(spark, d):
    p = points(spark, d).select("id", F.struct("x", "y").alias("p"))
    later = [p.select((F.col("id") - k).alias("id"), F.col("p").alias(f"p{k}")) for k in (1, 2, 3)]
    rows = p.join(later[0], "id").join(later[1], "id").join(later[2], "id")
    at = S.locate(F.array("p", "p1", "p2"), F.col("p3"))
    return rows.select("id", at.alias("at")).select("id", F.round("at.dist", 6).alias("dist"), F.round("at.share", 6).alias("share"))


def _at(share: str, axis: str) -> str:
    """SQL: a coordinate at a share of the line a, b, c with legs la, lb."""
    t = f"({share} * (la + lb))"
    return f"CASE WHEN {t} <= la THEN {axis}a + {t} / la * ({axis}b - {axis}a) ELSE {axis}b + ({t} - la) / lb * ({axis}c - {axis}b) END"


@query(f"""WITH {_P}, f AS (SELECT a.id, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS xc, c.y AS yc, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS la, sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)) AS lb FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = a.id + 2)
 SELECT id, CAST(CASE WHEN la > 0.4 * (la + lb) AND la < 0.7 * (la + lb) THEN 3 ELSE 2 END AS INTEGER) AS points, round({_at('0.4', 'x')}, 6) AS x_start, round({_at('0.4', 'y')}, 6) AS y_start, round({_at('0.7', 'x')}, 6) AS x_end, round({_at('0.7', 'y')}, 6) AS y_end FROM f""")
def line_substring(spark, d):
    p = points(spark, d).select("id", F.struct("x", "y").alias("p"))
    b, c = (p.select((F.col("id") - k).alias("id"), F.col("p").alias(f"p{k}")) for k in (1, 2))
    part = p.join(b, "id").join(c, "id").select("id", S.substring(F.array("p", "p1", "p2"), F.lit(0.4), F.lit(0.7)).alias("part"))
    first, last = F.element_at("part", 1), F.element_at("part", -1)
    return part.select("id", F.size("part").alias("points"), F.round(first["x"], 6).alias("x_start"), F.round(first["y"], 6).alias("y_start"), F.round(last["x"], 6).alias("x_end"), F.round(last["y"], 6).alias("y_end"))


@query()
def line_coverage(spark, d):
    seg = segments(spark, d)
    out = S.line_coverage(seg, seg, 0.05, 0.25)
    return out.select("id", F.round("length", 9).alias("length"), F.round("covered", 9).alias("covered"))


@query(f"""WITH {_P} SELECT id, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(-41 - (y * 10 - 38)) / 2), 2) + cos(radians(y * 10 - 38)) * cos(radians(-41)) * pow(sin(radians(-63 - (x * 10 - 65)) / 2), 2)))), 3) AS m FROM p""")
def haversine_pairs(spark, d):
    p = points(spark, d)
    return p.select("id", F.round(N.haversine_m(F.col("x") * 10 - 65, F.col("y") * 10 - 38, F.lit(-63.0), F.lit(-41.0)), 3).alias("m"))


def _albers_sql() -> str:
    import math

    p = N.ALBERS
    e = math.sqrt(p["e2"])
    one, two, zero = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    m1, m2 = (math.cos(x) / math.sqrt(1 - p["e2"] * math.sin(x) ** 2) for x in (one, two))
    q = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    n = (m1**2 - m2**2) / (q(math.sin(two)) - q(math.sin(one)))
    c = m1**2 + n * q(math.sin(one))
    rho0 = p["a"] * math.sqrt(c - n * q(math.sin(zero))) / n
    return f"""WITH {_P}, s AS (SELECT id, x * 10 - 65 AS lon, sin(radians(y * 10 - 38)) AS s FROM p), r AS (SELECT id, {p["a"]!r} * sqrt({c!r} - {n!r} * (1 - {e * e!r}) * (s / (1 - {e * e!r} * s * s) - ln((1 - {e!r} * s) / (1 + {e!r} * s)) / {2 * e!r})) / {n!r} AS rho, {n!r} * radians(lon - ({p["lon0"]!r})) AS theta FROM s)
 SELECT id, round(rho * sin(theta), 3) AS ax, round({rho0!r} - rho * cos(theta), 3) AS ay FROM r"""


@query(_albers_sql())
def albers_xy(spark, d):
    x, y = N.albers(F.col("x") * 10 - 65, F.col("y") * 10 - 38)
    return points(spark, d).select("id", F.round(x, 3).alias("ax"), F.round(y, 3).alias("ay"))


@query(f"WITH {_P} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND b.x BETWEEN a.x - 0.01 AND a.x + 0.02 AND b.y BETWEEN a.y - 0.01 AND a.y + 0.02")
def range_bbox_join(spark, d):
    p = points(spark, d).select("id", "x", "y")
    size = 0.05
    box = p.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    box = box.select("*", F.explode(F.sequence(S.cell(F.col("xa") - 0.01, size), S.cell(F.col("xa") + 0.02, size))).alias("cx")).select("*", F.explode(F.sequence(S.cell(F.col("ya") - 0.01, size), S.cell(F.col("ya") + 0.02, size))).alias("cy"))
    own = p.select(F.col("id").alias("b"), "x", "y", S.cell(F.col("x"), size).alias("cx"), S.cell(F.col("y"), size).alias("cy"))
    inside = F.col("x").between(F.col("xa") - 0.01, F.col("xa") + 0.02) & F.col("y").between(F.col("ya") - 0.01, F.col("ya") + 0.02)
    return own.join(box, ["cx", "cy"]).filter(inside & (F.col("a") != F.col("b"))).select("a", "b")


@query(f"WITH {_P}, t AS (SELECT id, floor((x * 10 - 65 + 180) / 360 * 1024) AS tx, floor((1 - asinh(tan(radians(y * 10 - 38))) / pi()) / 2 * 1024) AS ty FROM p) SELECT CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, count(*) AS n, min(id) AS first FROM t GROUP BY 1, 2")
def tile_assign(spark, d):
    x, y = N.mercator(F.col("x") * 10 - 65, F.col("y") * 10 - 38, 10)
    return points(spark, d).select("id", F.floor(x).cast("long").alias("tx"), F.floor(y).cast("long").alias("ty")).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"WITH {_P} SELECT a.id, round(abs((a.x * b.y - b.x * a.y) + (b.x * c.y - c.x * b.y) + (c.x * a.y - a.x * c.y)) / 2, 9) AS area, round(a.x + (b.x - a.x) / 2, 9) AS mid_x FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = a.id + 2")
def ring_area(spark, d):
    p = points(spark, d).select("id", F.struct("x", "y").alias("p"))
    b, c = (p.select((F.col("id") - k).alias("id"), F.col("p").alias(f"p{k}")) for k in (1, 2))
    rows = p.join(b, "id").join(c, "id")
    return rows.select("id", F.round(S.shoelace(F.array("p", "p1", "p2", "p")), 9).alias("area"), F.round(S.interpolate_at(F.array("p", "p1"), F.lit(0.5))["x"], 9).alias("mid_x"))


@query(f"WITH {_P} SELECT label, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, round(avg(x), 9) AS cx FROM p GROUP BY label")
def extent(spark, d):
    return points(spark, d).groupBy("label").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.round(F.avg("x"), 9).alias("cx"))


@query("SELECT vec_id, round((embedding[1] - embedding[2]) / nullif(CAST(abs(embedding[1]) + abs(embedding[2]) AS DOUBLE), 0), 6) AS ratio FROM embeddings")
def normalised_ratio(spark, d):
    from ..operators.raster import ratio

    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(ratio(e[0].cast("double"), e[1].cast("double")), 6).alias("ratio"))


ORACLES["normalised_ratio"] = "WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS q FROM embeddings) SELECT vec_id, round((p - q) / nullif(abs(p) + abs(q), 0), 6) AS ratio FROM b"


@query("""WITH l AS (SELECT label, vec_id % 7 AS px, CAST(embedding[1] AS DOUBLE) > 0 AS wet, CAST(embedding[3] AS DOUBLE) > -0.1 AS valid FROM embeddings)
 SELECT label, px, count(*) FILTER (WHERE valid) AS looks, CASE WHEN count(*) FILTER (WHERE valid) >= 3 THEN round(CAST(count(*) FILTER (WHERE valid AND wet) AS DOUBLE) / count(*) FILTER (WHERE valid), 6) END AS freq FROM l GROUP BY 1, 2""")
def water_frequency(spark, d):
    from ..operators.raster import frequency

    e = F.col("embedding")
    looks = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("px"), (e[0] > 0).alias("wet"), (e[2].cast("double") > -0.1).alias("valid"))
    return frequency(looks, ["label", "px"], 3).withColumn("freq", F.round("freq", 6))
