"""Small rules of names, identifiers and classes over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..operators import naming
from ..operators.assign import dense_ids
from ..sources.tables import table
from .registry import catalogue

QUERIES, ORACLES, query = catalogue()


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, CAST(NULL AS DOUBLE) AS none FROM events")
def numeric_path(spark, d):
    return table(spark, d, "events").select("event_id", R.finite_at(F.col("props"), "k").alias("k"), R.finite_at(F.col("props"), "k.x").alias("none"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '0' || o_orderkey WHEN 2 THEN o_orderkey || '-a' ELSE 'Río ' || o_orderkey END AS raw FROM orders)
 SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '[a-z0-9-]{1,64}') THEN raw END AS river, CASE WHEN regexp_full_match(raw, '[a-z0-9][a-z0-9-]{0,127}') THEN raw END AS stream,
 CASE WHEN regexp_full_match(raw, '[1-9][0-9]{0,9}') THEN CAST(raw AS BIGINT) END AS reach, lower(strip_accents(raw)) AS search FROM r""")
def input_validators(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("0"), k)).when(k % 4 == 2, F.concat(k, F.lit("-a"))).otherwise(F.concat(F.lit("Río "), k))
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", R.river_id(F.col("raw")).alias("river"), R.stream_id(F.col("raw")).alias("stream"), R.reach_id(F.col("raw")).alias("reach"), R.search_query(F.col("raw")).alias("search"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE NULL END AS status FROM orders")
def status_mapping(spark, d):
    """A status that the table does not name would stop the query; P is kept without one."""
    from ..functions.text import label

    raw = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", R.map_status(label(raw), {"o": "open", "f": "closed"}).alias("status"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus)")
def exists_pair(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    return table(spark, d, "orders").join(pairs, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderstatus") == F.col("l_linestatus")), "left_semi").select("o_orderkey")


_LINES = "SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS a, CAST(l_quantity + 10 AS DOUBLE) AS b FROM lineitem"


@query(f"WITH l AS ({_LINES}) SELECT x.o, x.n, count(*) AS n_over, sum(least(x.b, y.b) - greatest(x.a, y.a)) AS covered FROM l x JOIN l y ON x.o = y.o AND y.n < x.n AND y.a < x.b AND x.a < y.b GROUP BY x.o, x.n")
def priority_overlap(spark, d):
    """Spans that a span of higher precedence in the same cell overlaps, and by how much."""
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + 10).alias("b"))
    first = spans.select(*[F.col(c).alias(f"{c}2") for c in spans.columns])
    over = spans.join(first, (F.col("o") == F.col("o2")) & (F.col("n2") < F.col("n")) & (F.col("a2") < F.col("b")) & (F.col("a") < F.col("b2")))
    return over.groupBy("o", "n").agg(F.count(F.lit(1)).alias("n_over"), F.sum(F.least("b", "b2") - F.greatest("a", "a2")).alias("covered"))


@query("""WITH t AS (SELECT c_custkey, (c_nationkey % 5) AS tier, c_mktsegment = 'BUILDING' AS unnamed, -c_acctbal AS s FROM customer)
 SELECT c_custkey, row_number() OVER (ORDER BY tier, unnamed, s, c_custkey) AS prio FROM t""")
def tier_priority(spark, d):
    """One order over all tiers: tier, named first, largest first, then the identifier."""
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("tier"), (F.col("c_mktsegment") == "BUILDING").alias("unnamed"), (-F.col("c_acctbal")).alias("s"))
    return dense_ids(rows, ["tier", "unnamed", "s", "c_custkey"], "prio").select("c_custkey", "prio")


@query("""SELECT p_partkey, round(p_retailprice / 10, 6) AS far, p_size * 10 AS source, p_size >= 1 AND p_retailprice / 10 / (p_size * 10) * 100 >= 20 AND p_retailprice / 10 / 1200 * 100 >= 8 AS real FROM part""")
def detail_check(spark, d):
    far, source = F.col("p_retailprice") / 10, F.col("p_size") * 10
    real = R.detail_verdict(far, source.cast("double"), F.lit(1200.0), 20, 8)["real"]
    return table(spark, d, "part").select("p_partkey", F.round(far, 6).alias("far"), source.alias("source"), real.alias("real"))


@query("""SELECT p_partkey, round(CASE WHEN p_size > 0 AND p_retailprice > 0 THEN p_size * 10000 / (p_retailprice * 1000) END, 9) AS width,
 CASE WHEN p_size < 4 THEN 'ultraOligotrophic' WHEN p_size < 10 THEN 'oligotrophic' WHEN p_size < 35 THEN 'mesotrophic' WHEN p_size <= 100 THEN 'eutrophic' ELSE 'hypereutrophic' END AS trophic,
 CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_type = 'ECONOMY' THEN 3 ELSE 1 END AS piece, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS flow FROM part""")
def class_rules(spark, d):
    size, price, k = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    order = R.piece_order(F.when(k % 3 == 0, size), F.lit("t"), F.col("p_type"), {"t:ECONOMY": 3, "*": 1})
    flow = R.flow_code(F.when(k % 2 == 0, "perennial").otherwise("intermittent"))
    return table(spark, d, "part").select("p_partkey", F.round(R.band_width_m(size, price), 9).alias("width"), R.trophic_class(size).alias("trophic"), order.alias("piece"), flow.alias("flow"))


_LAYERS = ("emb", "nat", "bh130", "perenne", "hydrolakes")


@query("""WITH w AS (SELECT s_suppkey, (['emb', 'nat', 'bh130', 'perenne', 'hydrolakes'])[s_suppkey % 5 + 1] AS layer, s_nationkey % 4 AS t FROM supplier)
 SELECT s_suppkey, CASE WHEN layer = 'hydrolakes' THEN 'hydrolakes-' || s_suppkey WHEN layer IN ('emb', 'nat') THEN 'aprhi-' || layer || '-' || s_suppkey ELSE 'ign-' || layer || '-' || s_suppkey END AS id,
 CASE WHEN layer IN ('emb', 'bh130') OR layer = 'hydrolakes' AND t = 2 THEN 'reservoir' WHEN layer = 'hydrolakes' AND t = 3 THEN 'controlled-lake' ELSE 'lake' END AS kind, CAST(s_suppkey % 5 AS INTEGER) AS tier,
 'supplier-' || s_suppkey || '-' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS section FROM w JOIN supplier USING (s_suppkey)""")
def water_ids(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("*", F.element_at(F.array(*map(F.lit, _LAYERS)), (k % 5 + 1).cast("int")).alias("layer"))
    layer = F.col("layer")
    section = R.section_id(R.named_id(F.lit("Supplier"), k), F.col("s_nationkey"))
    return rows.select("s_suppkey", R.water_id(layer, k.cast("string")).alias("id"), R.water_kind(layer, F.col("s_nationkey") % 4).alias("kind"), R.water_tier(layer).alias("tier"), section.alias("section"))


@query("""WITH n AS (SELECT s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'b' END) || s_suppkey AS name FROM supplier)
 SELECT s_suppkey, name, row_number() OVER (ORDER BY s_suppkey % 2, s_suppkey) AS place FROM n""")
def natural_order(spark, d):
    """A2 before A10: figures by their value, letters without case."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.when(k % 2 == 0, "A").otherwise("b"), k).alias("name"))
    return dense_ids(rows.withColumn("key", R.natural_key(F.col("name"))), ["key", "s_suppkey"], "place").select("s_suppkey", "name", "place")


@query("""SELECT c_custkey, CAST(list_reduce(list_transform(range(1, CAST(length(c_name) AS BIGINT) + 1), lambda i: CAST(ascii(c_name[i]) AS HUGEINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) AS seed FROM customer""")
def text_seeds(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.text_seed(F.col("c_name")).alias("seed"))


@query()
def seeded_numbers(spark, d):
    """A first random number for each customer, by its name."""
    return table(spark, d, "customer").select("c_custkey", F.round(R.seeded_unit(R.text_seed(F.col("c_name"))), 9).alias("u"))


#: Short forms of kinds of waters, and names that are written with them.
SHORT = {"a": "Arroyo", "r": "Río", "cda": "Cañada", "q": "Quebrada", "c": "Cañada"}
WRITTEN = {
    "A. Biguá": "Arroyo Biguá", "Cda. Busto": "Cañada Busto", "Brazo R. Carnero": "Brazo Río Carnero", "A. Q. del Rodeo": "Arroyo Quebrada del Rodeo", "A.Yerutí": "Arroyo Yerutí",
    "A.  Canna  glauca": "Arroyo Canna glauca", "R. Tercero (Ctalamochita)": "Río Tercero", "A. Arroyo 630": "Arroyo 630", "A. Cda de los Duendes (Seco)": "Arroyo Cañada de los Duendes",
}
_WRITTEN = ", ".join(f"'{x}'" for x in WRITTEN.values())


@query(f"SELECT c_custkey, ([{_WRITTEN}])[c_custkey % {len(WRITTEN)} + 1] AS display, CASE c_custkey % {len(WRITTEN)} WHEN 6 THEN 'Ctalamochita' WHEN 8 THEN 'Seco' ELSE '' END AS others FROM customer")
def agency_names(spark, d):
    raw = F.element_at(F.array(*map(F.lit, WRITTEN)), (F.col("c_custkey") % len(WRITTEN) + 1).cast("int"))
    name = N.agency_name(raw, SHORT, ["Arroyo", "Río", "Cañada", "Quebrada", "Brazo"], ["cda"])
    return table(spark, d, "customer").select("c_custkey", name.alias("n")).select("c_custkey", "n.display", F.array_join("n.others", "|").alias("others"))


@query("""WITH c AS (SELECT l_orderkey AS display, l_linenumber AS n, l_suppkey AS s, l_discount * 10 AS share FROM lineitem),
 t AS (SELECT c.display, c.share, 'rio ' || c.display AS k, 'rio ' || c.s AS m FROM c),
 u AS (SELECT DISTINCT 'rio ' || o_orderkey AS m FROM orders WHERE o_orderkey % 2 = 0),
 near AS (SELECT display, m, share, levenshtein(k, m) AS distance FROM t WHERE share >= 0.5 AND levenshtein(k, m) BETWEEN 1 AND 2 AND m NOT IN (SELECT m FROM u) AND display NOT IN (SELECT display FROM t WHERE share >= 0.5 AND k = m))
 SELECT 'Río ' || display AS display, 'Río ' || substr(m, 5) AS name, round(share, 6) AS share, distance FROM near QUALIFY row_number() OVER (PARTITION BY display ORDER BY distance, share DESC, m) = 1""")
def spelling_corrections(spark, d):
    rio = lambda c: F.concat(F.lit("Río "), c)
    candidates = table(spark, d, "lineitem").select(rio("l_orderkey").alias("display"), rio("l_suppkey").alias("name"), (F.col("l_discount") * 10).alias("share"))
    used = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(rio("o_orderkey").alias("display"))
    return naming.corrections(candidates, used).withColumn("share", F.round("share", 6))


@query("SELECT event_type, count(DISTINCT user_id) AS points FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def name_votes(spark, d):
    return naming.name_votes(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 1 AND l_linenumber = 2 OR l_orderkey = 3 AND l_linenumber BETWEEN 1 AND 3 OR l_orderkey IN (5, 7)")
def selected_sections(spark, d):
    """Lines of orders by a request of one identifier, a range and two whole orders; what of it is not there is left out of the request."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("river"), F.col("l_linenumber").alias("place"))
    there = {r.id for r in rows.filter("l_orderkey IN (1, 3)").select("id").collect()}
    span = sorted(x for x in there if x in ("3-1", "3-2", "3-3"))
    only = ["1-2"] if "1-2" in there else []
    only += [f"{span[0]}..{span[-1]}"] if span else []
    known = {r.river for r in rows.filter("l_orderkey IN (5, 7)").select("river").distinct().collect()}
    return naming.select_ids(rows, ",".join(only), ",".join(sorted(known))).select("l_orderkey", "l_linenumber")


_TREE = """WITH RECURSIVE n AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey >= 8 THEN CAST(c_custkey // 8 AS VARCHAR) END AS parent FROM customer WHERE c_custkey > 0),
 p AS (SELECT id, [id] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, list_append(p.path, n.id) FROM n JOIN p ON n.parent = p.id)"""


def _tree(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").filter(k > 0).select(k.cast("string").alias("id"), F.when(k >= 8, F.floor(k / 8).cast("string")).alias("parent"))


@query(f"{_TREE} SELECT id, array_to_string(path, '/') AS path FROM p")
def ancestor_paths(spark, d):
    return naming.ancestor_paths(_tree(spark, d)).select("id", F.array_join("path", "/").alias("path"))


@query(f"{_TREE} SELECT id, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) AS place FROM p")
def depth_first_order(spark, d):
    paths = naming.ancestor_paths(_tree(spark, d))
    return dense_ids(paths, ["path"], "place").select("id", (F.size("path") - 1).cast("long").alias("depth"), "place")


@query("""WITH q AS (SELECT o_orderkey, ['Mostrame la cuenca del Neuquén ' || o_orderkey || '?', 'Show me the Limay sub-basin', 'río  Negro!'][o_orderkey % 3 + 1] AS raw FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'neuquen ' || o_orderkey WHEN 1 THEN 'limay sub-' ELSE 'rio negro' END AS name, o_orderkey % 3 < 2 AS wants_basin FROM q""")
def question_parsing(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Mostrame la cuenca del Neuquén "), k, F.lit("?"))).when(k % 3 == 1, "Show me the Limay sub-basin").otherwise("río  Negro!")
    return table(spark, d, "orders").select("o_orderkey", R.parse_question(raw).alias("q")).select("o_orderkey", "q.name", "q.wants_basin")


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_size + 95 AS DOUBLE) AS b FROM part)
 SELECT p_partkey, CAST(len(list_filter([2, 1], lambda k: a - k * 20 >= 0)) AS INTEGER) AS first, CAST(len(list_filter([2, 1], lambda k: a - k * 20 >= 0)) + 6 AS INTEGER) AS last,
 array_to_string(list_transform(list_concat(list_transform(list_filter([2, 1], lambda k: a - k * 20 >= 0), lambda k: a - k * 20), list_transform([0, 1, 2, 3, 4], lambda k: a + k * 20), [b], list_transform(list_filter([1, 2], lambda k: b + k * 20 <= 160), lambda k: b + k * 20)), lambda s: CAST(CAST(s AS BIGINT) AS VARCHAR)), ',') AS s FROM p""")
def stations_padded(spark, d):
    a = F.col("p_size").cast("double")
    at = R.station_positions(a, a + 95, 20.0, F.lit(160.0), 2)
    rows = table(spark, d, "part").select("p_partkey", at.alias("t"))
    return rows.select("p_partkey", "t.first", "t.last", F.array_join(F.transform("t.s", lambda s: s.cast("long").cast("string")), ",").alias("s"))


@query("SELECT s_suppkey, 3 AS n, CAST(s_suppkey AS DOUBLE) AS x1, CAST(0.5 AS DOUBLE) AS y1, CASE WHEN s_nationkey < 10 THEN 0 ELSE 1 END AS segment FROM supplier")
def wkt_points(spark, d):
    k = F.col("s_suppkey")
    points = R.line_wkt(F.concat(F.lit("LINESTRING ("), k, F.lit(" 0.5, "), k + 10, F.lit(" 0.5, "), k + 30, F.lit(" 0.5)")))
    segment = R.segment_at(F.array(F.lit(0.0), F.lit(10.0), F.lit(30.0)), F.col("s_nationkey"))
    rows = table(spark, d, "supplier").select("s_suppkey", points.alias("p"), segment.alias("segment"))
    return rows.select("s_suppkey", F.size("p").alias("n"), F.col("p")[0]["x"].alias("x1"), F.col("p")[0]["y"].alias("y1"), "segment")
