"""Contracted chains, widest paths, levels and flux against plain walks and a dense solve."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from fluvius.operators import flows as N
from fluvius.operators import parts
from fluvius.operators.graph import CycleError
from fluvius.operators.parts import in_parts

EDGES = "src long, dst long, width double, cost double, length double, shortcut boolean"


def network(r, n):
    """Edges upwards by id: chains of three, and jumps."""
    rows = []
    for i in range(n - 1):
        rows.append((i, i + 1, r.choice([None, 1.0, 2.0, 3.0]), float(r.randint(0, 2)), float(r.randint(1, 4)), r.random() < 0.2))
        if r.random() < 0.25 and i + 2 < n:
            rows.append((i, r.randint(i + 1, min(n - 1, i + 9)), r.choice([None, 2.0, 4.0]), float(r.randint(0, 3)), 1.5, False))
    return [e for e in rows if r.random() < 0.93]


def plain_widest(rows, starts, n):
    """Labels settled in order of ids, as all edges go upwards."""
    best = {i: (math.inf, 0.0, 0.0, 0, i) for i in starts}
    for v in range(n):
        if v in starts:
            continue
        into = [(best[e[0]], e) for e in rows if e[1] == v and e[0] in best]
        found = [(min(b[0], math.inf if e[2] is None else e[2]), b[1] + e[3], b[2] + e[4], b[3] + bool(e[5]), b[4]) for b, e in into]
        if found:
            best[v] = min(found, key=lambda f: (-f[0], *f[1:]))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_widest_equals_walk_in_order(spark, seed):
    r = random.Random(seed)
    rows, starts = network(r, 90), {0, 20, 41}
    edges = spark.createDataFrame([*rows, (None, 3, 1.0, 0.0, 0.0, False), (4, None, 1.0, None, None, None)], EDGES)
    got = N.widest(edges, spark.createDataFrame([(i,) for i in [*starts, 20, None]], "id long")).collect()
    assert len(got) == len({g.id for g in got})
    assert {g.id: (g.width, g.cost, g.length, g.shortcuts, g.source) for g in got} == plain_widest(rows, starts, 90)


def test_widest_of_all_paths_on_cycles(spark):
    r = random.Random(5)
    rows = [(r.randrange(9), r.randrange(9), float(r.randint(1, 6)), 0.0, 1.0, False) for _ in range(22)]
    want = {0: math.inf}

    def go(v, w, seen):
        for a, b, width, *_ in rows:
            if a == v and b not in seen:
                want[b] = max(want.get(b, 0.0), min(w, width))
                go(b, min(w, width), seen | {b})

    go(0, math.inf, {0})
    got = N.widest(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(0,)], "id long")).collect()
    assert {g.id: g.width for g in got} == want


def test_linked_ends_and_empty(spark):
    edges = spark.createDataFrame([(0, 1, 4.0, 0.0, 6.0, False), (1, 2, None, 4.0, 4.0, False), (0, 3, 1.0, 0.0, 9.0, False), (0, 4, 5.0, 0.0, 2.0, True)], EDGES)
    start, ends = spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 9)], "id long")
    got = {g.id: g.reason for g in N.linked_ends(edges, start, ends, 2.0, 0.3, N.F.lit(5.0)).collect()}
    assert got == {0: "unreached", 1: None, 2: "connectors", 3: "narrow", 4: "short", 9: "unreached"}
    none = edges.limit(0)
    assert N.widest(none, start.limit(0)).isEmpty() and N.levels(none, start.limit(0)).isEmpty()
    assert [tuple(x) for x in N.widest(none, start).collect()] == [(0, 0, math.inf, 0.0, 0.0, 0)]


def test_levels_on_long_chains_and_rings(spark):
    r = random.Random(8)
    rows = [e for e in network(r, 80)] + [(i, i + 1, 1.0, 0.0, 1.0, False) for i in range(100, 3000)]
    want = dict.fromkeys([*range(80), *range(100, 3001)], 0)
    for a, b, *_ in sorted(rows, key=lambda e: e[:2]):
        want[b] = max(want[b], want[a] + 1)
    ids = spark.createDataFrame([(i,) for i in want], "id long")
    assert {x.id: x.level for x in N.levels(spark.createDataFrame(rows, EDGES), ids).collect()} == want
    for ring in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 2), (3, 4)]):
        with pytest.raises(CycleError):
            N.levels(spark.createDataFrame(ring, "src long, dst long"), spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"))


def test_parts_are_labelled_whatever_task_holds_their_edges(spark):
    r = random.Random(3)
    rows = [(f"n{i}", f"n{r.randrange(i + 1, i + 4)}") for i in range(0, 200, 2) if i % 40]
    group = {x: {x} for e in rows for x in e}
    for a, b in rows:
        whole = group[a] | group[b]
        for x in whole:
            group[x] = whole
    edges = spark.createDataFrame([*rows, (None, "n1"), ("n1", None)], "src string, dst string")
    for tasks in (1, 7):
        out, held = in_parts(edges.repartition(tasks))
        part = {v.id: v.part for v in held.collect()}
        assert all(part[x] in group[x] and (part[x] == part[y]) == (y in group[x]) for x in group for y in group)
        assert part.keys() == group.keys() and sorted((v.src, v.dst) for v in out.collect()) == sorted(rows) and all(part[v.src] == v.part for v in out.collect())


def test_parts_that_lie_together_are_not_cut_by_batches(spark, monkeypatch):
    """Chains of 30 edges in batches of 100: none takes rounds over all; and the parts are right where most of a batch is one."""
    monkeypatch.setattr(parts, "BATCH", 100)
    monkeypatch.setattr(parts, "TAIL", 10)
    batches = lambda rows: [pa.RecordBatch.from_pydict({"src": [a for a, _ in rows[k : k + 7]], "dst": [b for _, b in rows[k : k + 7]]}) for k in range(0, len(rows), 7)]
    rows = [(31 * c + k, 31 * c + k + 1) for c in range(40) for k in range(30)]
    out = pa.Table.from_batches(parts._label(iter(batches(rows)))).to_pylist()
    assert len(out) == len(rows) and all(x["part"] == x["src"] // 31 * 31 for x in out)
    long = [(k, k + 1) for k in range(1000)]
    out = pa.Table.from_batches(parts._label(iter(batches(long)))).to_pylist()
    assert sorted((x["src"], x["dst"]) for x in out) == long and all(x["part"] <= x["src"] for x in out)


@pytest.mark.parametrize("whole", [0, 40])
def test_only_wanted_nodes_have_rows(spark, whole):
    r = random.Random(9)
    rows = network(r, 60) + [(a + 1000, b + 1000, *e) for a, b, *e in network(r, 30)]
    edges = spark.createDataFrame(rows, EDGES)
    begin, wanted = ({*a} for a in ((0, 20, 1000, 8000, 8001), (5, 20, 59, 1007, 1029, 8000, 7000)))
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "id long")
    all_ = [tuple(x) for x in N.widest(edges, ids(begin), whole).collect()]
    got = [tuple(x) for x in N.widest(edges, ids(begin), whole, ids([*wanted, None, 5])).collect()]
    assert sorted(got) == sorted(x for x in all_ if x[0] in wanted) and {20, 8000} <= {x[0] for x in got}
    nodes = {a for a, *_ in rows} | {b for _, b, *_ in rows}
    level = dict(map(tuple, N.levels(edges, ids(nodes), whole).collect()))
    some = dict(map(tuple, N.levels(edges, ids([5, 1007, 5, 7000]), whole).collect()))
    assert some == {5: level[5], 1007: level[1007], 7000: 0}


@pytest.mark.parametrize("whole", [0, 40])
def test_large_parts_take_rounds_with_the_same_results(spark, whole):
    r = random.Random(6)
    rows = network(r, 60) + [(a + 1000 + 100 * k, b + 1000 + 100 * k, *e) for k in range(6) for a, b, *e in network(r, 12)]
    edges = spark.createDataFrame(rows, EDGES)
    begin = spark.createDataFrame([(i,) for i in (0, 1000, 1003, 1100, 1200, 1500, 9000)], "id long")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(N.widest(edges, begin, whole), N.widest(edges, begin))
    ids = edges.select("src").union(edges.select("dst")).union(begin).withColumnRenamed("src", "id")
    assert same(N.levels(edges, ids, whole), N.levels(edges, ids))
    shared = edges.select("src", "dst", N.F.lit(0.4).alias("share")).union(edges.filter("src % 5 = 1").select("dst", "src", N.F.lit(0.15)))
    put = begin.withColumn("amount", N.F.lit(2.0))
    one, all_ = (dict(map(tuple, N.solve_flux(shared, put, whole=w).collect())) for w in (whole, 10**6))
    assert one == pytest.approx(all_, abs=1e-9) and len(one) > 40


def test_many_small_networks_take_no_rounds(spark, monkeypatch):
    for name in ("_widest_in_rounds", "_levels_in_rounds", "_flux_in_rounds"):
        monkeypatch.setattr(N, name, None)
    e = spark.range(40_000).selectExpr("id AS src", "id + 1 AS dst", "CAST(id % 7 AS DOUBLE) AS width", "0.0 AS cost", "1.0 AS length", "false AS shortcut", "0.5 AS share").filter("src % 20 < 19")
    begin = spark.range(0, 40_000, 20).withColumn("amount", N.F.lit(1.0))
    assert N.widest(e, begin).groupBy("length").count().filter("count <> 2000").isEmpty()
    assert N.levels(e, spark.range(40_000)).groupBy("level").count().filter("count <> 2000").isEmpty()
    assert N.solve_flux(e, begin).filter("abs(flux - pow(0.5D, id % 20)) > 1e-12").isEmpty()
    with pytest.raises(CycleError):
        N.levels(e.unionByName(e.filter("src = 45").selectExpr("dst AS src", "src AS dst"), allowMissingColumns=True), spark.range(40_000))


@pytest.mark.parametrize("seed", range(2))
def test_flux_equals_dense_solve(spark, seed):
    r = random.Random(seed)
    n = 60
    rows = [(i, i + 1, 0.6) for i in range(n - 1)]
    rows += [(i, r.randrange(n), 0.3) for i in range(n - 1) if r.random() < 0.3]
    a, put = np.zeros((n, n)), np.zeros(n)
    for s, d, share in rows:
        a[d, s] += share
    put[[0, 7]] = 1.0, 3.0
    x = np.linalg.solve(np.eye(n) - a, put)
    sources = spark.createDataFrame([(0, 1.0), (7, 1.0), (7, 2.0), (None, 1.0)], "id long, amount double")
    got = {g.id: g.flux for g in N.solve_flux(spark.createDataFrame(rows, "src long, dst long, share double"), sources).collect()}
    assert [got.get(i, 0.0) for i in range(n)] == pytest.approx(x.tolist(), abs=1e-9)


def test_flux_is_conserved_and_closed_cycles_raise(spark):
    rows = [(0, 1, 1.0), (1, 2, 0.5), (1, 3, 0.5), (2, 1, 0.4), (2, 4, 0.6), (3, 4, 1.0), (8, 9, 1.0), (9, 8, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, share double")
    one = spark.createDataFrame([(0, 1.0)], "id long, amount double")
    got = {g.id: g.flux for g in N.solve_flux(edges, one).collect()}
    assert got[4] == pytest.approx(1.0) and got[1] == pytest.approx(1.25) and not {8, 9} & got.keys()
    with pytest.raises(CycleError):
        N.solve_flux(edges, spark.createDataFrame([(8, 1.0)], "id long, amount double"), rounds=5)
