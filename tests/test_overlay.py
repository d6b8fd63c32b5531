"""Overlay against slabs cut at all crossings, and merged lines against walks in plain Python."""

import random
from collections import defaultdict

import pytest

from fluvius.operators import chains as C
from fluvius.operators import overlay as O

KIND = "grp long, layer int, poly long, ring int, seq int, x double, y double"


def edges(spark, polygons):
    """polygons: (grp, layer, poly, [rings]), outer rings counter-clockwise, holes clockwise."""
    rows = [(g, layer, p, k, i, float(x), float(y)) for g, layer, p, rings in polygons for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    return O.ring_edges(spark.createDataFrame(rows, KIND), ["grp", "layer", "poly"])


def slabs(polygons, rule):
    """Area of what the rule keeps: between two neighbouring heights of points and crossings no edges cross."""
    lines = [(layer, p, a, b) for _, layer, p, rings in polygons for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    ys = {y for _, _, a, b in lines for y in (a[1], b[1])}
    for _, _, a, b in lines:
        for _, _, c, d in lines:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                if 0 <= t <= 1:
                    ys.add(a[1] + t * (b[1] - a[1]))
    ys, area = sorted(ys), 0.0
    for low, high in zip(ys, ys[1:], strict=False):
        y = (low + high) / 2
        hits = sorted((a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]), layer, p) for layer, p, a, b in lines if (a[1] <= y) != (b[1] <= y))
        inside, x0 = defaultdict(int), None
        for x, layer, p in hits:
            if x0 is not None:
                n = [sum(v % 2 for (la, _), v in inside.items() if la == k) for k in (0, 1)]
                keep = {"union": n[0] + n[1] > 0, "intersection": n[0] > 0 and n[1] > 0, "difference": n[0] > 0 and n[1] == 0, "overlap": n[0] + n[1] > 1}[rule]
                area += keep * (x - x0) * (high - low)
            inside[layer, p] += 1
            x0 = x
    return area


def areas(df):
    return {r.grp: r.area for r in O.measure(df).collect()}


def random_polygons(seed, n):
    r, out = random.Random(seed), []
    for k in range(n):
        pts = [(r.randint(0, 20), r.randint(0, 20)) for _ in range(3)]
        twice = (pts[1][0] - pts[0][0]) * (pts[2][1] - pts[0][1]) - (pts[1][1] - pts[0][1]) * (pts[2][0] - pts[0][0])
        if twice:
            out.append((1, k % 2, k, [pts if twice > 0 else pts[::-1]]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_triangles_on_small_integers(spark, seed):
    """Shared edges, shared points, edges within edges and many crossings."""
    polygons = random_polygons(seed, 9)
    counted = O.sides(edges(spark, polygons), 4.0).cache()
    for rule in O.RULES:
        assert areas(O.outline(counted, rule)).get(1, 0) == pytest.approx(slabs(polygons, rule), abs=1e-6), rule


def test_tiles_become_their_outline_with_its_hole(spark):
    tiles = [(7, 0, 10 * i + j, [[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]]) for i in range(4) for j in range(4) if (i, j) not in ((1, 1), (2, 1))]
    out = O.outline(O.sides(edges(spark, tiles), 1.5), "union")
    rows = O.rings(out).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.seq):
        by[r.ring].append((r.x, r.y))
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    assert sorted(area(p) for p in by.values()) == [-2, 16] and areas(out) == {7: 14}


def test_rings_that_touch_in_a_point_stay_apart(spark):
    two = [(1, 0, 1, [[(0, 0), (1, 0), (1, 1), (0, 1)]]), (1, 0, 2, [[(1, 1), (2, 1), (2, 2), (1, 2)]])]
    rows = O.rings(O.outline(O.sides(edges(spark, two), 1.0), "union")).collect()
    assert sorted(sum(1 for r in rows if r.ring == k) for k in {r.ring for r in rows}) == [4, 4]


def test_holes_groups_equal_polygons_and_nothing(spark):
    ring = [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)]]
    plug = [[(2, 2), (4, 2), (4, 4), (2, 4)]]
    some = [(1, 0, 1, ring), (1, 1, 2, plug), (2, 0, 3, plug), (2, 1, 4, plug), (2, 0, 5, plug)]
    counted = O.sides(edges(spark, some), 2.5).cache()
    assert areas(O.outline(counted, "union")) == {1: 36, 2: 4}
    assert areas(O.outline(counted, "intersection")) == {2: 4}
    assert areas(O.outline(counted, "difference")) == {1: 32}
    assert O.rings(O.outline(O.sides(edges(spark, some).filter("false"), 1.0), "union")).collect() == []


def lines_by_hand(segments):
    """{frozenset of ids} and which are closed."""
    ends = defaultdict(list)
    for i, a, b in segments:
        for v in (a, b):
            if v is not None:
                ends[v].append(i)
    parent = {i: i for i, _, _ in segments}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    joints = defaultdict(int)
    for ids in ends.values():
        if len(ids) == 2:
            parent[find(ids[0])] = find(ids[1])
    for ids in ends.values():
        if len(ids) == 2:
            joints[find(ids[0])] += 1
    groups = defaultdict(list)
    for i, _, _ in segments:
        groups[find(i)].append(i)
    return {tuple(sorted(g)): joints[k] == len(g) for k, g in groups.items()}


@pytest.mark.parametrize("seed", range(4))
def test_merged_lines_on_random_multigraphs(spark, seed):
    r = random.Random(seed)
    segments = [(i, r.randint(0, 40), r.randint(0, 40)) for i in range(1, 36)] + [(50, 90, 91), (51, 92, 91), (52, 92, 90), (60, 95, 95), (61, None, 97), (62, 97, None), (70, 98, 99), (71, 99, 98)]
    got = C.merge_lines(spark.createDataFrame(segments, "id long, a long, b long")).collect()
    assert sorted(x.id for x in got) == sorted(i for i, _, _ in segments)
    by, of = defaultdict(list), {i: (a, b) for i, a, b in segments}
    for x in got:
        by[x.chain].append(x)
    assert {tuple(sorted(x.id for x in g)): g[0].closed for g in by.values()} == lines_by_hand(segments)
    for chain, g in by.items():
        g.sort(key=lambda x: x.seq)
        assert [x.seq for x in g] == list(range(len(g))) and chain == min(x.id for x in g)
        path = [of[x.id] if x.forward else of[x.id][::-1] for x in g]
        assert all(p[1] == q[0] for p, q in zip(path, path[1:], strict=False))
        assert not g[0].closed or path[-1][1] == path[0][0]


def test_a_long_line(spark):
    n = 3000
    rows = spark.range(1, n + 1).selectExpr("id", "id * 7 % 3001 as a", "(id + 1) * 7 % 3001 as b")
    got = C.merge_lines(rows).collect()
    assert len(got) == n and len({x.chain for x in got}) == 1 and sorted(x.seq for x in got) == list(range(n))


def test_stretches_under_many_polygons_are_met_once(spark):
    """2,000 boxes over each other: what is met in pairs must not grow with the boxes that lie on one stretch."""
    boxes = [(1, k % 2, k, [[(x, 0), (x + 2 + k % 3, 0), (x + 2 + k % 3, 2), (x, 2)]]) for k in range(2000) for x in [k * 7 % 20]]
    some = edges(spark, boxes)
    assert O.merged(some).count() <= 2 * 24 + 25
    counted = O.sides(some, 8.0).cache()
    for rule in O.RULES:
        cells = [[sum(1 for _, la, _, r in boxes if la == n and r[0][0][0] <= x < r[0][1][0]) for n in (0, 1)] for x in range(24)]
        assert areas(O.outline(counted, rule)).get(1, 0) == 2 * sum(bool({"union": a + b > 0, "intersection": a > 0 and b > 0, "difference": a > 0 and b == 0, "overlap": a + b > 1}[rule]) for a, b in cells)


@pytest.mark.parametrize("cell", [0.7, 1.0, 5.0, 50.0])
def test_sides_do_not_depend_on_cells(spark, cell):
    polygons = random_polygons(11, 14) + [(1, 1, 90, [[(-9, -9), (3, -9), (3, 4), (-9, 4)], [(-6, -6), (-6, 1), (1, 1), (1, -6)]])]
    counted = O.sides(edges(spark, polygons), cell).cache()
    for rule in ("union", "difference"):
        assert areas(O.outline(counted, rule)).get(1, 0) == pytest.approx(slabs(polygons, rule), abs=1e-6), rule


def test_rounds_of_rings_follow_the_longest_ring_not_the_table(spark, monkeypatch):
    """600 rings of 1 to 8 and paths of up to 8 beside them: whole after four doublings, whatever the table's size."""
    nxt, start = {}, 1
    for k in range(600):
        size = k % 8 + 1
        ids = list(range(start, start + size))
        random.Random(k).shuffle(ids)
        nxt |= dict(zip(ids, [*ids[1:], ids[0] if k % 3 else None], strict=True))
        start += size
    written, settle = [], C.settle
    monkeypatch.setattr(C, "settle", lambda rows: written.append(1) or settle(rows))
    found = {r["id"]: r for r in C.chase(spark.createDataFrame(list(nxt.items()), "id long, nxt long")).collect()}
    assert len(written) <= 6 and len(found) == len(nxt)
    for i in nxt:
        way = [i]
        while nxt[way[-1]] is not None and nxt[way[-1]] != i:
            way.append(nxt[way[-1]])
        r, open_ = found[i], nxt[way[-1]] is None
        assert r["end"] == (way[-1] if open_ else None)
        if open_:
            assert r["steps"] == len(way) - 1
        else:
            assert r["low"] == min(way) and r["far"] == way.index(min(way))
