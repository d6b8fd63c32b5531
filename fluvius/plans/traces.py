"""Name traces over the tree of customers, ranks of touching pieces, similar words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces as T
from ..operators.fuzzy import similar_names
from ..sources.tables import table
from .graphs import _T, tree
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()

_KIND = "CASE WHEN h = 0 THEN 'blocked' WHEN h < 9 THEN 'strong' WHEN h < 12 THEN 'weak' WHEN h < 14 THEN 'lake' ELSE 'gap' END"


@query(f"""{_T}, n AS (SELECT *, {_KIND} AS kind, CASE WHEN h BETWEEN 1 AND 11 THEN id * 13 % 50 ELSE 0 END AS own FROM (SELECT CAST(r_regionkey AS BIGINT) AS trace, id, next, area, (id * 31 + r_regionkey * 17) % 20 AS h FROM t CROSS JOIN region)),
 w AS (SELECT trace, id, next, area, kind, 0 AS gaps, kind <> 'strong' AS lead, own AS e, CAST(0 AS BIGINT) AS place FROM n WHERE id = trace + 1
 UNION ALL SELECT n.trace, n.id, n.next, n.area, n.kind, CASE WHEN n.kind = 'strong' THEN 0 ELSE w.gaps + CAST(n.kind = 'gap' AS INTEGER) END, w.lead AND n.kind <> 'strong', w.e + n.own, w.place + 1 FROM w JOIN n ON n.trace = w.trace AND n.next = w.id
 WHERE n.kind <> 'blocked' AND (n.kind = 'strong' OR w.lead OR w.gaps + CAST(n.kind = 'gap' AS INTEGER) <= 1)),
 s AS (SELECT trace, id, next, area, e AS best FROM w WHERE kind = 'strong' AND place > 0 UNION SELECT w.trace, w.id, w.next, w.area, s.best FROM s JOIN w ON w.trace = s.trace AND w.id = s.next AND w.place > 0),
 m AS (SELECT trace, id, next, area, max(best) AS best FROM s GROUP BY ALL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace, next ORDER BY best DESC, area DESC, id) AS rn FROM m) WHERE rn = 1),
 p AS (SELECT trace, id FROM w WHERE place = 0 UNION ALL SELECT c.trace, c.id FROM p JOIN c ON c.trace = p.trace AND c.next = p.id) SELECT trace, id, place, CAST(round(e / 10.0, 6) AS DOUBLE) AS evidence FROM p JOIN w USING (trace, id)""")
def name_trace(spark, d):
    t = tree(spark, d).crossJoin(F.broadcast(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("trace"))))
    t = t.withColumn("h", (F.col("id") * 31 + F.col("trace") * 17) % 20).withColumn("kind", F.expr(_KIND)).withColumn("evidence", F.col("id") * 13 % 50 / 10)
    starts = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("trace"), (F.col("r_regionkey").cast("long") + 1).alias("id"))
    return T.name_trace(t, starts, 1, free_lead=True).withColumn("evidence", F.round("evidence", 6))


_ENDS = "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS grp, c_custkey % 9 = 0 AS ranked, c_custkey % 7 + 1 AS rank, CAST(c_custkey * 7919 % 1009 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 997 AS DOUBLE) AS y FROM customer"
_PIECES = f"WITH RECURSIVE q AS ({_ENDS}), z AS (SELECT id, grp, x, y FROM q UNION ALL SELECT id, grp, x + 60, y + 30 FROM q)"


@query(f"""{_PIECES}, k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM z a JOIN z b ON a.grp = b.grp AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 80),
 f AS (SELECT id, 0 AS layer FROM q WHERE ranked UNION SELECT k.b, layer + 1 FROM f JOIN k ON k.a = f.id JOIN q ON q.id = k.b WHERE NOT q.ranked AND layer < 60), l AS (SELECT id, min(layer) AS layer FROM f GROUP BY id),
 r AS (SELECT l.id, l.layer, rank FROM l JOIN q USING (id) WHERE layer = 0 UNION SELECT k.b, n.layer, greatest(q.rank, r.rank) FROM r JOIN k ON k.a = r.id JOIN l n ON n.id = k.b AND n.layer = r.layer + 1 JOIN q ON q.id = k.b),
 v AS (SELECT id, max(rank) AS rank, min(layer) AS layer FROM r GROUP BY id), o AS (SELECT * FROM z WHERE id NOT IN (SELECT id FROM v)), g AS (SELECT z.*, v.rank FROM z JOIN v USING (id)),
 j AS (SELECT o.id, g.rank, g.id AS other, sqrt((o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y)) AS dist FROM o JOIN g USING (grp)), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rn FROM j) WHERE rn = 1)
 SELECT id, rank, layer, CAST(NULL AS DOUBLE) AS dist FROM v UNION ALL SELECT q.id, greatest(q.rank, h.rank), NULL, round(h.dist, 6) FROM q LEFT JOIN h USING (id) WHERE q.id NOT IN (SELECT id FROM v)""")
def spread_ranks(spark, d):
    i = F.col("c_custkey")
    rows = table(spark, d, "customer").select(i.alias("id"), F.col("c_nationkey").cast("long").alias("grp"), (i % 9 == 0).alias("ranked"), (i % 7 + 1).alias("rank"))
    x, y = (F.col("id") * 7919 % 1009).cast("double"), (F.col("id") * 104729 % 997).cast("double")
    ends = rows.select("id", F.inline(F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 60).alias("x"), (y + 30).alias("y")))))
    return T.spread_ranks(rows, ends, 80.0, 1500.0).withColumn("dist", F.round("dist", 6))


_FIRST = r"^\s*([A-Za-z]+)"


@query(f"""WITH w AS (SELECT DISTINCT lower(regexp_extract(text, '{_FIRST}', 1)) AS name FROM documents), v AS (SELECT name FROM w WHERE name <> '')
 SELECT a, b, round(s, 6) AS s FROM (SELECT a.name AS a, b.name AS b, 1 - CAST(levenshtein(a.name, b.name) AS DOUBLE) / greatest(length(a.name), length(b.name)) AS s FROM v a JOIN v b ON a.name < b.name) WHERE s >= 0.7""")
def similar_openings(spark, d):
    """Pairs of similar words among those that documents open with."""
    return similar_names(table(spark, d, "documents").select(F.lower(F.regexp_extract("text", _FIRST, 1)).alias("name"))).withColumn("s", F.round("s", 6))
