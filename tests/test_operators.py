"""Operators on small fixtures with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvius.functions import hydro as H
from fluvius.functions import text as X
from fluvius.operators import checks, docs, graph, raster, sequences, spatial, tiers
from fluvius.sources import tables

LINKS = [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 0)]


def nodes(spark, rows, names="id long, next long"):
    return spark.createDataFrame(rows, names)


def ids(df):
    return sorted(r.id for r in df.collect())


def roots(spark, *r):
    return spark.createDataFrame([(x,) for x in r], "id long")


def test_closure_and_cycles(spark):
    t = nodes(spark, LINKS)
    assert ids(graph.closure(t, roots(spark, 1))) == [1, 2, 3, 4, 5]
    assert ids(graph.closure(t, roots(spark, 4))) == [4]
    loop = nodes(spark, [(1, 2), (2, 1)])
    assert ids(graph.closure(loop, roots(spark, 1))) == [1, 2]
    with pytest.raises(graph.CycleError):
        graph.depth(loop)


def test_closure_of_a_long_chain(spark):
    n = 100_000
    t = spark.range(1, n + 1).select("id", (F.col("id") - 1).alias("next"))
    assert graph.closure(t, roots(spark, 40_000)).count() == n - 40_000 + 1


def test_closure_roots_and_side_cycles(spark):
    t = nodes(spark, [(1, 0), (2, 1), (3, 2), (5, 6), (6, 5), (7, 5), (8, 99)])
    assert ids(graph.closure(t, roots(spark, 1, 3))) == [1, 2, 3]
    assert ids(graph.closure(t, roots(spark, 6))) == [5, 6, 7]
    assert ids(graph.closure(t, roots(spark, 99))) == [8, 99]
    assert ids(graph.closure(t.limit(0), roots(spark, 4))) == [4]


def test_pruned_ends_equal_repeated_removal(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        below = {k: (0 if k == 1 or r.random() < 0.05 else 999 if r.random() < 0.05 else r.randint(1, k - 1)) for k in range(1, 61)}
        keep = {k for k in below if r.random() < 0.15}
        left = set(below)
        while gone := {k for k in left if k not in keep and (below[k] not in left or not any(below[x] == k for x in left))}:
            left -= gone
        t = nodes(spark, [(k, n, k in keep) for k, n in below.items()], "id long, next long, good boolean")
        assert ids(graph.prune_ends(t, F.col("good"))) == sorted(left)


def test_deep_chain(spark):
    n = 3_000
    t = spark.range(1, n + 1).select("id", (F.col("id") - 1).alias("next"))
    assert graph.depth(t).agg(F.max("depth")).head()[0] == n


def test_branches(spark):
    t = nodes(spark, [(1, 0, 106), (2, 1, 106), (3, 2, 100), (8, 2, 5), (4, 3, 60), (5, 3, 40), (6, 4, 55), (7, 6, 50)], "id long, next long, area long")
    assert ids(graph.major_mouths(t, "area", 20)) == [1, 4, 5]
    assert ids(graph.major_mouths(t, "area", 50)) == [1]
    assert ids(graph.largest_branch(t, 1, "area")) == [1, 2, 3, 4, 6, 7]
    t = nodes(spark, [(1, 0, 100), (2, 1, 100), (3, 2, 60), (4, 2, 40), (5, 4, 30)], "id long, next long, area long")
    assert ids(graph.largest_branch(t, 1, "area", claimed=F.col("id") == 3)) == [1, 2, 4, 5]
    assert ids(graph.largest_branch(t, 1, "area", claimed=F.col("id").isin(3, 4))) == [1, 2]


def test_streams(spark):
    def found(rows):
        out = {}
        for r in graph.streams(nodes(spark, rows, "id long, next long, key string"), "key", 2).collect():
            out.setdefault(r.stream, set()).add(r.id)
        return sorted(map(sorted, out.values()))

    assert found([(1, 0, "A"), (2, 1, "A"), (3, 2, "A"), (10, 0, "A")]) == [[1, 2, 3], [10]]
    assert found([(1, 0, "A"), (2, 1, None), (3, 2, "A")]) == [[1, 2, 3]]
    assert found([(1, 0, "A"), (2, 1, None), (3, 2, None), (4, 3, None), (5, 4, "A")]) == [[1], [5]]


def test_flux_by_capacity(spark):
    e = spark.createDataFrame([(1, 2, 90.0), (2, 3, 60.0), (2, 4, 30.0), (3, 5, 60.0), (4, 5, 30.0)], "src long, dst long, w double")
    out = {r.id: r.flux for r in graph.flux(graph.shares(e, "w", 1.5), roots(spark, 1, 2, 3, 4, 5)).collect()}
    a, b = 60**1.5, 30**1.5
    assert out[3] == pytest.approx(a / (a + b)) and out[4] == pytest.approx(b / (a + b)) and out[5] == pytest.approx(1)


@pytest.mark.parametrize(
    "values, length, shortest, n",
    [([1, 1, 1, 2, 1, 1, 1, 1, 1, 1], 1000, 250, 1), ([1, 1, None, 1, 1], 500, 150, 1), ([1, 2, 2, 1], 400, 200, 3), ([1, 1, 2, 3, 3], 500, 500, 3), ([2, 1, 1, 1], 400, 150, 2), ([None, 5, None], 300, 500, 3), ([1, 2, 1, 3, 1], 500, 150, 1)],
)
def test_smoothing(values, length, shortest, n):
    assert len(sequences.smooth(values, length / len(values), shortest)) == n


def test_smoothing_judges_all_runs_of_a_pass():
    assert sequences.smooth([0, 1, 0, 1, 0, 0], 1, 2) == [(0, 6, 0)]
    assert sequences.smooth([1, 2, 1, 2, 2], 1, 2) == [(0, 2, 1), (2, 5, 2)]


@pytest.mark.parametrize(
    "number, question, found",
    [(100, "rios de mas de 100 km", True), (1000, "mas de 1 000 m", True), (1000, "mas de 1.000 m", True), (1.5, "pendiente mayor a 1 5", True), (1.5, "slope above 1.5", True), (5, "mas de 50 km", False), (300, "mas de 200 km", False), (100, "the longest river", False), (10, "entre 10 20 km", True), (200, "100,200 km", True), (1.5, "1,50", True)],
)
def test_number_in_question(spark, number, question, found):
    assert spark.range(1).select(X.grounded(F.lit(question), F.lit(float(number))).alias("x")).head().x is found


@pytest.mark.parametrize("name, broken", [("Rio(2)", False), ("Rio (Viejo)", False), ("Rio(Viejo)", True), ("ParedPn", True), ("Ca?ada", True), ("Rio (Viejo", True), ("Rio Negro", False)])
def test_damaged_names(spark, name, broken):
    assert spark.range(1).select(X.damaged(F.lit(name)).alias("x")).head().x is broken


def test_runs_of_nulls(spark):
    rows = [(0, k, v) for k, v in enumerate([1, 1, None, None, 2])]
    out = sequences.runs(spark.createDataFrame(rows, "k int, i int, v int"), "k", ["i"], "v")
    assert sorted((r.run_from, r.run_to, r.v) for r in out.collect()) == [(0, 2, 1), (2, 4, None), (4, 5, 2)]


def test_text_forms(spark):
    row = spark.range(1).select(
        X.normalize(F.lit("  Río  Collón Curá ")).alias("a"), X.search_terms(F.array(F.lit("Río Negro"), F.lit("Negro"), F.lit("negro"))).alias("b"),
        X.name_terms(F.array(F.lit("Cañadón Grande"))).alias("c"), X.similarity(F.lit("limai"), F.lit("limay")).alias("d"), X.similarity(F.lit(""), F.lit("")).alias("e"),
        X.similarity(F.lit("neu"), F.lit("neuquen")).alias("f"), X.grounded(F.lit("mas de 100 km"), F.lit(100)).alias("g"), X.grounded(F.lit("1.000"), F.lit(1000)).alias("h"), X.grounded(F.lit("50"), F.lit(5)).alias("i"), X.grounded(F.lit("1 5"), F.lit(1.5)).alias("j"),
    ).head()
    assert row.a == "rio collon cura" and row.b == ["rio negro", "negro"] and row.c == ["canadon grande", "grande"]
    assert row.d == pytest.approx(0.8) and row.e == 1 and row.f == pytest.approx(3 / 7)
    assert row.g and row.h and not row.i and row.j


def test_point_vote(spark):
    rows = [(10, 6, 0), (10, 1, 5), (10, 3, 3), (10, 2, 2), (0, 0, 0)]
    out = tiers.vote(spark.createDataFrame(rows, "n int, p int, i int").repartition(1), "n", "p", "i", 0.5, ("perennial", "intermittent"))
    got = {(r.n, r.p, r.i): r.vote for r in tiers.vote(spark.createDataFrame(rows, "n int, p int, i int"), "n", "p", "i", 0.3, ("perennial", "intermittent")).collect()}
    assert got[10, 6, 0] == got[10, 3, 3] == "perennial" and got[10, 1, 5] == "intermittent" and got[10, 2, 2] is None and got[0, 0, 0] is None
    assert out.count() == 5


def test_coverage_interval_matches_sampling():
    r = np.random.default_rng(4)
    s, t = r.uniform(-1, 1, (300, 4)), r.uniform(-1, 1, (300, 4))
    lo, hi = spatial.covered_interval(s, t, 0.3)
    u = np.linspace(0, 1, 4001)
    for k in range(300):
        length = np.hypot(s[k, 2] - s[k, 0], s[k, 3] - s[k, 1])
        p = s[k, :2] + u[:, None] * (s[k, 2:] - s[k, :2])
        d = t[k, 2:] - t[k, :2]
        w = np.clip(((p - t[k, :2]) @ d) / (d @ d), 0, 1)
        near = np.hypot(*(p - t[k, :2] - w[:, None] * d).T) <= 0.3
        want = near.mean() * length
        assert (0 if np.isnan(lo[k]) else hi[k] - lo[k]) == pytest.approx(want, abs=2e-3)


def test_line_coverage_meets_all_segments(spark):
    from fluvius.plans.spatial import line_coverage

    got = {r.id: (r.length, r.covered) for r in line_coverage(spark, "/root/testdata/sf0.001").collect()}
    e = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    seg = np.array([(*e[i][:2], *e[i + 1][:2]) for i in sorted(e) if i + 1 in e], float)
    ids = [i for i in sorted(e) if i + 1 in e]
    assert sorted(got) == ids
    for k in range(0, len(ids), 7):
        rest = np.delete(seg, k, 0)
        lo, hi = spatial.covered_interval(np.repeat(seg[k : k + 1], len(rest), 0), rest, 0.05)
        covered, end = 0.0, 0.0
        for p, q in sorted((p, q) for p, q in zip(lo, hi) if p < q):
            covered, end = covered + max(q - max(p, end), 0.0), max(end, q)
        assert got[ids[k]] == pytest.approx((np.hypot(*(seg[k, 2:] - seg[k, :2])), covered), abs=1e-8)
    rows = [(1, 0, 0.0, 0.0, 4.0, 0.0), (1, 1, 0.0, 0.01, 4.0, 0.01), (2, 0, 1.0, 0.5, 1.0, 0.5), (3, 0, 9.0, 9.0, 9.5, 9.5)]
    d = spark.createDataFrame(rows, "id long, seg int, x0 double, y0 double, x1 double, y1 double")
    few = {r.id: r.covered for r in spatial.line_coverage(d, d, 1.0, 10.0).collect()}
    assert few == pytest.approx({1: 2 * 0.75**0.5 + 2 * (1 - 0.49**2) ** 0.5, 3: 0.0})


def test_raster_zones_and_holes(spark):
    ring = [(r, c) for r in range(1, 4) for c in range(1, 4) if (r, c) != (2, 2)] + [(6, 6)]
    p = spark.createDataFrame(ring, "row long, col long")
    assert [tuple(r) for r in raster.holes(p, 8, 8).collect()] == [(2, 2)]
    assert raster.zones(p, 8).select("zone").distinct().count() == 2
    assert raster.closing(p).filter("row = 2 and col = 2").count() == 1
    assert raster.opening(spark.createDataFrame([(r, c) for r in range(3) for c in range(3)] + [(9, 9)], "row long, col long")).filter("row = 9").count() == 0
    assert raster.overlap(p, p).head()[0] == 1


def test_strict_json(spark):
    schema = T.StructType([T.StructField("_id", T.StringType(), False), T.StructField("v", T.DoubleType(), True)])
    lines = ['{"_id": "a", "v": 1}', '{"_id": "b", "x": 1}', '{"v": 2}', "nonsense", '{"_id": "c"}']
    out = tables.check_json(spark.createDataFrame([(x,) for x in lines], "value string"), "value", schema)
    assert {r.value: r.reason for r in out.collect()} == dict(zip(lines, [None, "unknown: x", "missing: _id", "not valid", None]))


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "á", [(1.23456789, 2.0), (3.0, 4.0)])], "id long, name string, line array<struct<x:double,y:double>>")
    tables.write_geojson_lines(df, f"file://{tmp_path}/lines", "LineString", "line")
    text = spark.read.text(f"file://{tmp_path}/lines").head()[0]
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[' + text + "]}")
    row = tables.read_any(spark, f"file://{tmp_path}/c.geojson").head()
    assert row.geometry_type == "LineString" and row.properties["name"] == "á" and row.coordinates.startswith("[[1.234568")
    tables.write_ordered_ndjson(df.select("id", "name"), f"file://{tmp_path}/o.ndjson", "id")
    assert tables.read_any(spark, f"file://{tmp_path}/o.ndjson", "id long, name string").head().name == "á"
    (tmp_path / "x.csv").write_bytes("a,b\n1,\n2,ñ\n".encode("ISO-8859-1"))
    assert [r.b for r in tables.read_any(spark, f"file://{tmp_path}/x.csv", "a int, b string", encoding="ISO-8859-1").collect()] == [None, "ñ"]


def test_checks(spark):
    a = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("s", 5.0)], "k string, v double")
    out = {r.k: (r.off, r.ok) for r in checks.conserved(a, a.filter("v <> 2"), "k", "v", 0.5).collect()}
    assert out == {"r": (2.0, False), "s": (0.0, True)}
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id int, v string")
    assert {r.id: r.action for r in docs.upsert_diff(old, new, "id").collect()} == {1: "matched", 2: "modified", 3: "deleted", 4: "inserted"}


def test_hydraulics_refuses_dry_reaches(spark):
    with pytest.raises(Exception, match="over 0"):
        spark.range(1).select(H.hydraulics(F.lit(0.0), F.lit(1.0))).collect()


def test_mass_balance(spark):
    pts = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(x).alias("load")) for q, x in ((2.0, 0.0), (5.0, 0.0), (5.5, 0.0))])
    c = spark.range(1).select(H.path_fold(pts, 0.1).alias("c")).head().c
    assert c == pytest.approx([0.1, 0.1, 0.1])


def test_clip_lines_alternates_at_crossings(spark):
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]
    edges = spark.createDataFrame([("p", *map(float, a + b)) for r in rings for a, b in zip(r, r[1:] + r[:1])], "poly string, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, -1.0, 1.5, 5.0, 1.5), (2, 3.0, 3.0, 3.5, 3.0), (3, 5.0, 5.0, 6.0, 5.0), (4, -1.0, -1.0, 5.0, 5.0), (5, 1.5, 1.5, 1.5, 3.0), (6, 3.0, 3.0, 3.0, 3.0), (7, 3.0, None, 3.0, 3.0)]
    s = spark.createDataFrame([(i, 0, *r) for i, *r in rows], "id long, seg int, x0 double, y0 double, x1 double, y1 double")
    for size in (0.5, 1.0, 10.0):
        got = sorted((r.id, round(r.lo * 6, 6), round(r.hi * 6, 6)) for r in spatial.clip_lines(s, edges, size).collect())
        assert got == [(1, 1.0, 2.0), (1, 3.0, 5.0), (2, 0.0, 6.0), (4, 1.0, 2.0), (4, 3.0, 5.0), (5, 2.0, 6.0)]
    assert spatial.clip_lines(s, edges.limit(0), 1.0).count() == 0 == spatial.clip_lines(s.limit(0), edges, 1.0).count()


def test_shortest_equals_a_heap(spark):
    import heapq
    import random

    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60), float(r.randint(0, 9))) for _ in range(220)]
    blocked, ends, sources = {7, 11}, {13}, [0, 5]
    want, heap = {}, [(0.0, s, s) for s in sources]
    while heap:
        d, src, n = heapq.heappop(heap)
        if n in want or n in blocked:
            continue
        want[n] = (d, src)
        if n not in ends:
            for a, b, w in links:
                if a == n:
                    heapq.heappush(heap, (d + w, src, b))
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    out = graph.shortest(spark.createDataFrame(links, "a long, b long, w double"), one(sources), one(blocked), one(ends)).collect()
    assert {x.id: (x.dist, x.source) for x in out} == want


def test_substring_keeps_vertices_between(spark):
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 0), (2, 2), (4, 2))])
    row = spark.range(1).select(spatial.substring(line, F.lit(0.25), F.lit(0.75)).alias("a"), spatial.substring(line, F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert [tuple(p) for p in row.a] == [(1.5, 0), (2, 0), (2, 0), (2, 2), (2.5, 2)]
    assert [tuple(p) for p in row.b] == [(0, 0), (2, 0), (2, 0), (2, 2), (4, 2)]


def test_marks_of_every_script_are_stripped(spark):
    import unicodedata

    texts = ["Río Ñire ÅÉ ǖẮ", "ά ὕ ΐ Ώ", "ў й ё ї Ѓ", "が パ", "각 ɨ ﬁ ß ø", "a\u0301 и\u0306", "क़ ा", "", None]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip_marks(F.col("t")).alias("s")).collect()
    assert [r.s and unicodedata.normalize("NFD", r.s) for r in rows] == [t and bare(t) for t in texts]


def test_snap_links_join_what_all_pairs_join(spark):
    """Links stay few where points lie densely, and give the components of all pairs within the radius."""
    r = np.random.default_rng(5)
    spots = np.concatenate([r.normal(0, 0.004, (400, 2)), r.uniform(-0.2, 0.2, (500, 2)), np.round(r.uniform(-0.1, 0.1, (100, 2)), 2), [[0.1, 0.1]] * 3])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(5000, None, 0.1), (5001, float("nan"), 0.1), (5002, float("nan"), 0.1)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    links = spatial.snap_links(p, 0.01).collect()
    parent = list(range(len(spots)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(2)) <= 0.01
    for a, b in zip(*np.nonzero(np.triu(far, 1)), strict=True):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(far[x.a, x.b] for x in links) and len(links) < far.sum() / 8
    got = graph.components(spark.createDataFrame(links, "a long, b long"), p)
    assert {x.id: x.component for x in got.collect()} == {**{i: find(i) for i in range(len(spots))}, 5000: 5000, 5001: 5001, 5002: 5002}


def test_nearest_searches_crowds_closely(spark, monkeypatch):
    """Rounds begin with a radius at which no cell is crowded; the result is that of all pairs, ties to the lowest id."""
    r = np.random.default_rng(6)
    at = np.round(np.concatenate([r.normal(0, 0.01, (600, 2)), r.uniform(-1, 1, (60, 2)), [[0.5, 0.5]] * 200]), 4)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at[::2])], "ida long, xa double, ya double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at[1::2])], "idb long, xb double, yb double")
    met, join = [], spatial.distance_join
    monkeypatch.setattr(spatial, "distance_join", lambda *args: met.append(join(*args)) or met[-1])
    d = np.sqrt(((at[::2][:, None] - at[1::2][None]) ** 2).sum(2))
    close = {x.ida: (x.idb, round(x.dist, 9)) for x in spatial.nearest(a, b, 0.3).collect()}
    assert close == {i: (int(d[i].argmin()), round(float(d[i].min()), 9)) for i in range(len(d)) if d[i].min() <= 0.3}
    assert sum(m.count() for m in met) < (d <= 0.3).sum() / 5
    anywhere = {x.ida: (x.idb, round(x.dist, 9)) for x in spatial.nearest_anywhere(a, b, 0.05, 10.0).collect()}
    assert anywhere == {i: (int(d[i].argmin()), round(float(d[i].min()), 9)) for i in range(len(d))}


def test_types_are_compared_once_for_all_their_parts(spark, tmp_path, monkeypatch):
    """Similarities are those of all pairs, nulls included, with runs of keys shorter than a type."""
    from itertools import combinations

    from fluvius.plans import texts

    kinds = ["SMALL TIN", "SMALL BRASS", "", None]
    rows = [(i * 37 % 101, kinds[i % 4], f"B{i % 3 % 2}", i % 2) for i in range(1, 60)] + [(200, "TIN", None, 1), (201, "TIN", None, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(texts, "RUN", 3)
    compared, plain = [], texts.X.similarity
    monkeypatch.setattr(texts.X, "similarity", lambda a, b: compared.append((str(a), str(b))) or plain(a, b))
    got = sorted((r.a, r.b) for r in texts.name_similarity(spark, str(tmp_path)).collect())
    assert got == sorted((min(p[0], q[0]), max(p[0], q[0])) for p, q in combinations(rows, 2) if p[2] is not None and p[2:] == q[2:])
    assert "t1" in compared[0][0] and "t2" in compared[0][1]
    by = {r[0]: r[1] for r in rows}
    for r in texts.name_similarity(spark, str(tmp_path)).collect():
        one, two = by[r.a], by[r.b]
        assert (r.s is None) == (one is None or two is None) and (one is None or one != two or r.s == 1.0)


def test_flux_sends_nothing_through_the_driver(spark, monkeypatch):
    """The layers of flux and levels are joined by merging, without broadcasts."""
    plans, add = [], graph.Layers.add
    monkeypatch.setattr(graph.Layers, "add", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or add(self, rows))
    e = spark.createDataFrame([(1, 2, 0.25), (1, 3, 0.75), (2, 3, 1.0)], "src long, dst long, share double")
    got = graph.flux(e, spark.createDataFrame([(1,), (2,), (3,)], "id long")).collect()
    assert {r.id: r.flux for r in got} == {1: 1.0, 2: 0.25, 3: 1.0}
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)
