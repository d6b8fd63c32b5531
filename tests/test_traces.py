"""Name traces, spread ranks and similar names against plain recursion and all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fluvius.operators import traces as T
from fluvius.operators.fuzzy import similar_names
from fluvius.operators.graph import CycleError, subtree_max

COLS = "trace long, id long, next long, kind string, evidence double, area double, x int, hop string"


def recursive_trace(rows, start, max_gap, free):
    """Path and evidence by depth first search; ``rows``: id -> (next, kind, evidence, area)."""
    ups = {}
    for i in sorted(rows):
        ups.setdefault(rows[i][0], []).append(i)

    def pick(found):
        found = [f for f in found if f]
        return min(found, key=lambda f: (-round(f[0], 6), -rows[f[1][0]][3], f[1][0])) if found else None

    def go(i, gaps, lead):
        kind, worth = rows[i][1], rows[i][2]
        if kind == "blocked":
            return None
        if kind == "strong":
            e, p = pick([go(u, 0, False) for u in ups.get(i, [])]) or (0.0, [])
            return worth + e, [i, *p]
        gaps += kind in ("gap", None)
        if gaps > max_gap and not lead:
            return None
        best = pick([go(u, gaps, lead) for u in ups.get(i, [])])
        return best and (best[0] + (worth if kind == "weak" else 0), [i, *best[1]])

    kind, worth = rows[start][1], rows[start][2]
    e, p = pick([go(u, 0, free and kind != "strong") for u in ups.get(start, [])]) or (0.0, [])
    return [start, *p], e + (worth if kind in ("strong", "weak") else 0)


@pytest.mark.parametrize("free", [False, True])
@pytest.mark.parametrize("max_gap", [0, 2])
def test_traces_equal_recursion(spark, max_gap, free):
    r, trees, starts = random.Random(max_gap * 2 + free), {}, []
    for k in range(12):
        kinds = ["strong", "weak", "gap", "lake", "blocked", None]
        at = {i: (0 if i == 1 else r.randint(max(1, i - 4), i - 1), r.choices(kinds, [8, 3, 5, 2, 1, 1])[0], r.randint(0, 4) / 2, float(r.randint(0, 2))) for i in range(1, 70)}
        trees[k] = at
        starts.append((k, r.choice([1, 1, 2, 5])))
    nodes = spark.createDataFrame([(k, i, *v, 1, "x") for k, at in trees.items() for i, v in at.items()] + [(99, 1, 0, "strong", 1.0, 1.0, 1, "x")], COLS)
    got = {}
    for row in T.name_trace(nodes, spark.createDataFrame([*starts, (77, 1)], "trace long, id long"), max_gap, free).collect():
        got.setdefault(row.trace, []).append((row.place, row.id, row.evidence))
    assert got.keys() == trees.keys()
    for k, start in starts:
        path, evidence = recursive_trace(trees[k], start, max_gap, free)
        assert [i for _, i, _ in sorted(got[k])] == path and max(got[k])[2] == pytest.approx(evidence)
    assert any(len(v) > 6 for v in got.values())


def test_trace_edges(spark):
    t = spark.createDataFrame([(1, 1, 0, "lake", 5.0, 1.0, 1, "x"), (1, 2, 1, "gap", None, None, 1, "x"), (1, 3, 2, "strong", None, None, 1, "x"), (1, 4, 1, "strong", 0.0, None, 1, "x")], COLS)
    one = spark.createDataFrame([(1, 1)], "trace long, id long")
    path = lambda *a: [(r.id, r.evidence) for r in T.name_trace(*a).orderBy("place").collect()]
    assert path(t, one, 1) == [(1, 0.0), (2, 0.0), (3, 0.0)]  # a tie: the lower id
    assert path(t, one, 0) == [(1, 0.0), (4, 0.0)]
    assert path(t.limit(0), one, 1) == [] and path(t, one.limit(0), 1) == []
    with pytest.raises(CycleError):
        T.name_trace(spark.createDataFrame([(1, 1, 2, "gap", 0.0, 0.0, 1, "x"), (1, 2, 1, "gap", 0.0, 0.0, 1, "x"), (1, 3, 0, "gap", 0.0, 0.0, 1, "x")], COLS), spark.createDataFrame([(1, 3)], "trace long, id long"), 1)


def test_trace_of_a_long_river(spark):
    n = 20_000
    t = spark.range(1, n + 1).selectExpr("CAST(7 AS LONG) AS trace", "id", "id - 1 AS next", "CASE WHEN id % 3 = 1 THEN 'strong' ELSE 'gap' END AS kind", "0.5 AS evidence", "1.0 AS area")
    one = spark.createDataFrame([(7, 1)], "trace long, id long")
    out = T.name_trace(t, one, 2)
    assert out.count() == n - 1 and out.agg({"evidence": "max"}).head()[0] == 0.5 * 6667  # the last reach is a gap
    assert T.name_trace(t, one, 1).count() == 1
    assert subtree_max(t, "id").filter(f"best <> {n}").isEmpty()


def test_ranks_equal_the_rule_layer_by_layer(spark):
    r = random.Random(4)
    pieces = [(i, r.choice([None, 1, 2, 3, 3]), r.random() < 0.15, r.randint(1, 5)) for i in range(140)] + [(900, 50, False, 2), (901, 50, None, 3)]
    ends = {i: [(r.random() * 90, r.random() * 90) for _ in range(r.choice([0, 1, 2, 2, 3]))] for i, *_ in pieces}
    far = lambda a, b: min((math.dist(p, q) for p in ends[a] for q in ends[b]), default=math.inf)
    want = {i: (rank, 0, None) for i, grp, ranked, rank in pieces if grp is None or ranked}
    group = {i: grp for i, grp, *_ in pieces}
    rank = {i: k for i, _, _, k in pieces}
    layer = 0
    while True:
        layer += 1
        near = {i: [want[j][0] for j in want if group[j] == group[i] and far(i, j) <= 9] for i in group if i not in want}
        if not any(near.values()):
            break
        want |= {i: (max(rank[i], *v), layer, None) for i, v in near.items() if v}
    for i in sorted(group.keys() - want.keys()):
        want[i] = min(((far(i, j), j) for j in want if want[j][1] is not None and group[j] == group[i] and far(i, j) < math.inf), default=None) or (rank[i], None, None)
        if want[i][1] is not None:
            d, j = want[i]
            want[i] = (max(rank[i], want[j][0]), None, pytest.approx(d))
    p = spark.createDataFrame([(*x, "x") for x in pieces], "id long, grp long, ranked boolean, rank int, layer string")
    e = spark.createDataFrame([(i, *q) for i, v in ends.items() for q in v], "id long, x double, y double")
    got = {v.id: (v.rank, v.layer, v.dist) for v in T.spread_ranks(p, e, 9.0, 200.0).collect()}
    assert got == want
    assert layer > 3 and any(v[1] is None and v[2] is not None for v in got.values())
    assert T.spread_ranks(p.limit(0), e, 9.0, 200.0).count() == 0
    assert T.spread_ranks(p, e.limit(0), 9.0, 200.0).count() == len(pieces)


@pytest.mark.parametrize("enough, width", [(16, 60), (0, 60), (0, 8), (0, 1)])
def test_highest_near_equals_all_pairs_where_points_crowd(spark, enough, width):
    r = random.Random(width)
    spot = lambda: (r.uniform(-width, width), r.choice([r.uniform(-width, width), 7.0]))
    asked = [(i // 2, r.randint(1, 2), *spot()) for i in range(600)] + [(800, 1, math.inf, 0.0), (801, 2, None, 0.0)]
    held = [(r.randint(1, 2), *q, r.choice([None, round(q[0]), r.randint(-9, 9)])) for q in (spot() for _ in range(500))] + [(1, 1e9, 1e9, 4)]
    want = {}
    for i, g, *p in asked:
        for h, x, y, rank in held:
            if g == h and None not in p and math.sqrt((p[0] - x) ** 2 + (p[1] - y) ** 2) <= 9.0:
                want[i] = max((x for x in (want.get(i), rank) if x is not None), default=None)
    a = spark.createDataFrame(asked, "id long, grp long, x double, y double")
    h = spark.createDataFrame(held, "grp long, x double, y double, rank int")
    assert {v.id: v.top for v in T.highest_near(a, h, 9.0, ["grp"], "rank", enough, 3).collect()} == want


def test_ranks_spread_in_a_crowd_without_its_pairs(spark):
    n = 30_000  # all touch: 900 million pairs
    p = spark.range(n).selectExpr("id", "1L AS grp", "id % 3 = 0 AS ranked", "CAST(id % 7 AS INT) AS rank")
    e = spark.range(n).selectExpr("id", "id % 173 / 50.0 AS x", "id % 211 / 50.0 AS y")
    got = T.spread_ranks(p, e, 9.0, 200.0).groupBy("layer").agg({"rank": "min", "*": "count"}).collect()
    assert sorted((v.layer, v["min(rank)"], v["count(1)"]) for v in got) == [(0, 0, 10_000), (1, 6, 20_000)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.7, 0.5])
def test_similar_names_equal_all_pairs(spark, least):
    r = random.Random(8)
    names = {"".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(150)} | {"rio colorado", "rio colorada", "colorado", "río négro", "rio negro", "x", "y" * 40, "y" * 30}
    want = {(a, b) for a in names for b in names if a < b and max(len(a), len(b)) and 1 - edit_distance(a, b) / max(len(a), len(b)) >= least and min(len(a), len(b))}
    d = spark.createDataFrame([(x, "s") for x in [*names, *names, None]], "name string, s string")
    assert {(v.a, v.b) for v in similar_names(d, least).collect()} == want
    assert similar_names(d.limit(0), least).count() == 0


def test_pairs_of_similar_names_are_compared_in_many_tasks(spark):
    """Few bytes can make many pairs: neither the join nor the comparison is put together into one task."""
    r = random.Random(5)
    names = spark.createDataFrame([("".join(r.choices("ab", k=9)),) for _ in range(400)], "name string")
    found = similar_names(names)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= min(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
