"""Planar geometry: cell joins, nearest, point in polygon, coverage of lines by neighbours.

A line is a table of segments (id, x0, y0, x1, y1); a polygon a table of edges.  Joins are
equi-joins on grid cells: one side is put in every cell that its box, grown by the radius,
touches, the other in its own, and the exact test follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(cell(lo, size), cell(hi, size)))


def distance_join(a: DataFrame, b: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Points a (ida, xa, ya) and b (idb, xb, yb) no farther apart than ``radius``, equal in the columns ``by``: ida, idb, dist.

    A point of b is in nine cells at most, and a pair shares exactly one of them.
    """
    x, y = F.col("xb"), F.col("yb")
    wide = b.select("*", _cells(x - radius, x + radius, radius).alias("cx")).select("*", _cells(y - radius, y + radius, radius).alias("cy"))
    own = a.withColumn("cx", cell(F.col("xa"), radius)).withColumn("cy", cell(F.col("ya"), radius))
    dist = F.sqrt(F.pow(F.col("xa") - x, 2) + F.pow(F.col("ya") - y, 2))
    return own.join(wide, ["cx", "cy", *(by or [])]).withColumn("dist", dist).filter(F.col("dist") <= radius).select("ida", "idb", "dist")


def snap_links(points: DataFrame, radius: float) -> DataFrame:
    """a, b: links between ``points`` (id, x, y) no farther apart than ``radius`` that join all that such links join, directly or by others.

    Points of one cell are all within the radius, so each is linked with the least id there.
    Of two cells one link is enough: quarters of cells that lie within the radius of one another
    as a whole give it, and only where none do are points compared, those of quarters that may
    hold a pair.  So there are as many links as points, and a few a cell, however dense they lie.
    """
    from .iterate import settle

    quarter = radius / 6  # four of them are a cell; its diagonal is 0.95 of the radius
    rows = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("abs(x) < double('infinity') and abs(y) < double('infinity')")
    rows = rows.withColumn("qx", cell(F.col("x"), quarter)).withColumn("qy", cell(F.col("y"), quarter))
    rows = settle(rows.withColumn("cx", F.floor(F.col("qx") / 4)).withColumn("cy", F.floor(F.col("qy") / 4)))
    lead = rows.groupBy("cx", "cy").agg(F.min("id").alias("b"))
    links = rows.join(lead, ["cx", "cy"]).filter("id <> b").select(F.col("id").alias("a"), "b")
    held = settle(rows.groupBy("cx", "cy", "qx", "qy").agg(F.min("id").alias("first")))
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    one = held.select(*[F.col(c).alias(f"{c}1") for c in held.columns], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead])).alias("to"))
    one = one.withColumn("cx", F.col("cx1") + F.col("to.i")).withColumn("cy", F.col("cy1") + F.col("to.j")).drop("to")
    dx, dy = F.abs(F.col("qx") - F.col("qx1")), F.abs(F.col("qy") - F.col("qy1"))
    far = lambda k: F.hypot(F.greatest(dx + k, F.lit(0)), F.greatest(dy + k, F.lit(0))) * quarter
    met = one.join(held, ["cx", "cy"]).filter(far(-1) <= radius * 1.001)
    met = settle(met.withColumn("sure", F.when(far(1) <= radius * 0.999, F.struct(F.col("first1").alias("a"), F.col("first").alias("b")))))
    cells = met.groupBy("cx1", "cy1", "cx", "cy").agg(F.min("sure").alias("sure"))
    open_ = met.join(cells.filter("sure IS NULL").drop("sure"), ["cx1", "cy1", "cx", "cy"], "left_semi").select("cx1", "cy1", "cx", "cy", "qx1", "qy1", "qx", "qy")
    side = rows.select(F.col("qx").alias("qx1"), F.col("qy").alias("qy1"), F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    both = open_.join(side, ["qx1", "qy1"]).join(rows.select("qx", "qy", F.col("id").alias("b"), "x", "y"), ["qx", "qy"])
    both = both.filter(F.sqrt(F.pow(F.col("xa") - F.col("x"), 2) + F.pow(F.col("ya") - F.col("y"), 2)) <= radius)
    found = both.groupBy("cx1", "cy1", "cx", "cy").agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b")
    return links.unionByName(cells.filter("sure IS NOT NULL").select("sure.a", "sure.b")).unionByName(found)


#: Places of b that a place of b shares its cell with, on average, in the first round of a search.
CROWD = 8


def _first_radius(b: DataFrame, radius: float, by: list[str]) -> float:
    """``radius``, or the largest quarter, sixteenth and so on of it at which cells of that size are not crowded."""
    size = F.lit(radius) / F.pow(F.lit(4.0), F.col("k"))
    spread = b.select(*by, "xb", "yb", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    held = spread.groupBy(*by, "k", F.floor(F.col("xb") / size).alias("cx"), F.floor(F.col("yb") / size).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    crowd = {r.k: r.c for r in held.groupBy("k").agg((F.sum(n * n) / F.sum(n)).alias("c")).collect()}
    return radius / 4.0 ** next((k for k in range(10) if crowd.get(k, 0.0) <= CROWD), 10)


def _search(a: DataFrame, b: DataFrame, radius: float, bound: float, by: list[str]) -> DataFrame:
    """Nearest b within ``bound``, in rounds of growing radius: those that have found one leave, so crowds are searched closely only.

    Up to ``radius`` it grows by four, as far as it goes beyond it doubles.  Of b at one place
    the lowest id stands for all.
    """
    from .iterate import settle

    b = settle(b.filter("xb + yb IS NOT NULL").groupBy(*by, "xb", "yb").agg(F.min("idb").alias("idb")))
    left, out, r = settle(a.select("ida", "xa", "ya", *by)), None, _first_radius(b, radius, by)
    while True:
        best = distance_join(left, b, r, by).groupBy("ida").agg(F.min(F.struct("dist", "idb")).alias("m"))
        found = settle(best.select("ida", F.col("m.idb").alias("idb"), F.col("m.dist").alias("dist")))
        out = found if out is None else out.unionByName(found)
        if r >= bound:
            return out
        left = settle(left.join(found.select("ida"), "ida", "left_anti"))
        if left.isEmpty():
            return out
        r = min(4 * r, radius) if r < radius else 2 * r


def nearest(a: DataFrame, b: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """ida, idb, dist of the nearest b within ``radius``; ties go to the lowest id."""
    return _search(a, b, radius, radius, by or [])


def nearest_anywhere(a: DataFrame, b: DataFrame, first: float, bound: float, by: list[str] | None = None) -> DataFrame:
    """Nearest b at any distance: the radius doubles for the points that have found none.

    ``bound`` is the extent of the data; beyond it a point has no neighbour to find.
    """
    # The last radius is the first doubled one beyond the bound.
    last = first
    while last <= bound:
        last *= 2
    return _search(a, b, first, last, by or [])


def point_in_polygon(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(id, x, y) within polygons of edges (poly, x0, y0, x1, y1) by even-odd crossings: id, poly.

    Edges are dealt to the rows of cells that they span; a horizontal ray meets only those.
    """
    spans = edges.select("*", _cells(F.least("y0", "y1"), F.greatest("y0", "y1"), size).alias("cy"))
    rows = points.withColumn("cy", cell(F.col("y"), size)).join(spans, "cy")
    at = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))
    crossing = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < at)
    return rows.groupBy("id", "poly").agg(F.count_if(crossing).alias("n")).filter("n % 2 = 1").select("id", "poly")


def clip_lines(segments: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Parts of segments (id, seg, x0, y0, x1, y1) inside polygons of edges (poly, x0, y0, x1, y1): id, seg, poly, lo, hi as shares of the segment.

    Segments and edges meet in the cells of a grid; a crossing counts in the cell that holds
    it.  Between crossings the side alternates from that of the segment's start (even-odd, so
    that rings inside rings are holes).  Parts come out whole, one row for each run inside.
    A segment without length, or with a null, has no part.
    """
    from pyspark.sql import Window

    key = ["id", "seg", "poly"]
    s = segments.select("id", "seg", "x0", "y0", "x1", "y1").filter("x0 + y0 + x1 + y1 IS NOT NULL AND NOT (x0 = x1 AND y0 = y1)")
    e = edges.select("poly", *[F.col(c).alias(f"{c[0]}{c[1]}e") for c in ("x0", "y0", "x1", "y1")])
    s_cells = s.select("*", _cells(F.least("x0", "x1"), F.greatest("x0", "x1"), size).alias("cx")).select("*", _cells(F.least("y0", "y1"), F.greatest("y0", "y1"), size).alias("cy"))
    e_cells = e.select("*", _cells(F.least("x0e", "x1e"), F.greatest("x0e", "x1e"), size).alias("cx")).select("*", _cells(F.least("y0e", "y1e"), F.greatest("y0e", "y1e"), size).alias("cy"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # On which side of the segment's line an end of the edge lies; an end on the line is on the right.
    side = lambda k: dx * (F.col(f"y{k}e") - F.col("y0")) - dy * (F.col(f"x{k}e") - F.col("x0"))
    met = s_cells.join(e_cells, ["cx", "cy"]).withColumn("a", side(0)).withColumn("b", side(1)).filter("(a > 0) != (b > 0)")
    u = F.col("a") / (F.col("a") - F.col("b"))
    met = met.withColumn("px", F.col("x0e") + u * (F.col("x1e") - F.col("x0e"))).withColumn("py", F.col("y0e") + u * (F.col("y1e") - F.col("y0e")))
    t = ((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / (dx * dx + dy * dy)
    # Rounding may put the point just outside both boxes: it then counts in their nearest cell.
    held = lambda v, *ends: cell(F.greatest(F.least(v, F.least(F.greatest(*ends[:2]), F.greatest(*ends[2:]))), F.greatest(F.least(*ends[:2]), F.least(*ends[2:]))), size)
    here = (F.col("cx") == held(F.col("px"), "x0", "x1", "x0e", "x1e")) & (F.col("cy") == held(F.col("py"), "y0", "y1", "y0e", "y1e"))
    crossings = met.withColumn("t", t).filter(here & (F.col("t") > 0) & (F.col("t") < 1)).select(*key, "t", F.lit(1).alias("flip"))
    starts = point_in_polygon(s.select(F.struct("id", "seg").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), edges, size)
    starts = starts.select("id.id", "id.seg", "poly", F.lit(0.0).alias("t"), F.lit(1).alias("flip"))
    rows = crossings.unionByName(starts).groupBy(*key, "t").agg(F.sum("flip").alias("flip"))
    w = Window.partitionBy(*key).orderBy("t")
    runs = rows.withColumn("inside", F.sum("flip").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1).withColumn("hi", F.coalesce(F.lead("t").over(w), F.lit(1.0)))
    return runs.filter("inside").select(*key, F.col("t").alias("lo"), "hi")


def locate(line: Column, point: Column) -> Column:
    """Where a line (array of (x, y)) is nearest to a point: struct of share (0 to 1) of its length, dist, x, y; the first of equal places."""
    n = F.size(line) - 2
    leg = lambda i: F.sqrt(F.pow(F.get(line, i + 1)["x"] - F.get(line, i)["x"], 2) + F.pow(F.get(line, i + 1)["y"] - F.get(line, i)["y"], 2))

    def near(i):
        a, b = F.get(line, i), F.get(line, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.when(leg(i) == 0, F.lit(0.0)).otherwise(((point["x"] - a["x"]) * dx + (point["y"] - a["y"]) * dy) / (dx * dx + dy * dy))
        t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
        x, y = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(F.sqrt(F.pow(point["x"] - x, 2) + F.pow(point["y"] - y, 2)).alias("dist"), i.alias("i"), t.alias("t"), x.alias("x"), y.alias("y"))

    at = F.sequence(F.lit(0), n)
    sum_to = lambda k: F.aggregate(F.filter(at, lambda i: i < k), F.lit(0.0), lambda acc, i: acc + leg(i))
    best = F.array_min(F.transform(at, near))
    share = (sum_to(best["i"]) + best["t"] * leg(best["i"])) / F.nullif(sum_to(n + 1), F.lit(0.0))
    return F.struct(F.coalesce(share, F.lit(0.0)).alias("share"), best["dist"].alias("dist"), best["x"].alias("x"), best["y"].alias("y"))


def substring(line: Column, lo: Column, hi: Column) -> Column:
    """The part of a line (array of (x, y)) between two shares (lo <= hi) of its length: its ends and the vertices strictly between."""
    at = F.sequence(F.lit(0), F.size(line) - 2)
    legs = F.transform(at, lambda i: F.sqrt(F.pow(F.get(line, i + 1)["x"] - F.get(line, i)["x"], 2) + F.pow(F.get(line, i + 1)["y"] - F.get(line, i)["y"], 2)))
    sum_to = lambda k: F.aggregate(F.slice(legs, 1, k), F.lit(0.0), lambda a, b: a + b)
    total = sum_to(F.size(legs))
    between = F.filter(line, lambda p, i: (sum_to(i) > lo * total) & (sum_to(i) < hi * total))
    xy = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return F.concat(F.array(xy(interpolate_at(line, lo))), F.transform(between, xy), F.array(xy(interpolate_at(line, hi))))


def covered_interval(s: np.ndarray, t: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Arc length [lo, hi] of segments s (n, 4) within ``r`` of segments t (n, 4); nan if none.

    The set is one interval, for the buffer of a segment is convex: the hull of what lies
    in the two discs and in the rectangle between them.
    """
    with np.errstate(all="ignore"):
        length = np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1])
        dx, dy = (s[:, 2] - s[:, 0]) / length, (s[:, 3] - s[:, 1]) / length
        parts = []
        for k in (0, 2):
            px, py = t[:, k] - s[:, 0], t[:, k + 1] - s[:, 1]
            along, off = px * dx + py * dy, px * dy - py * dx
            half = np.sqrt(r * r - off * off)
            parts.append((np.maximum(along - half, 0), np.minimum(along + half, length)))
        tl = np.hypot(t[:, 2] - t[:, 0], t[:, 3] - t[:, 1])
        ex, ey = (t[:, 2] - t[:, 0]) / tl, (t[:, 3] - t[:, 1]) / tl
        qx, qy = s[:, 0] - t[:, 0], s[:, 1] - t[:, 1]
        lo, hi = np.zeros(len(s)), length.copy()
        for c0, c1, least, most in ((qx * ex + qy * ey, dx * ex + dy * ey, 0.0, tl), (qy * ex - qx * ey, dy * ex - dx * ey, -r, r)):
            flat = np.abs(c1) < 1e-12
            p, q = (least - c0) / c1, (most - c0) / c1
            outside = flat & ~((c0 >= least) & (c0 <= most))
            lo = np.where(outside, np.nan, np.where(flat, lo, np.maximum(lo, np.minimum(p, q))))
            hi = np.where(flat, hi, np.minimum(hi, np.maximum(p, q)))
        parts.append((lo, hi))
        los, his = np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts])
        none = ~(los <= his)
        los[none], his[none] = np.inf, -np.inf
        lo, hi = los.min(0), his.max(0)
    return np.where(lo <= hi, lo, np.nan), np.where(lo <= hi, hi, np.nan)


def _pieces(size: float):
    """Segments (id, seg, x0, y0, x1, y1) cut at the lines of a grid: the piece, its cell and its start along the segment."""

    def work(batches):
        for pdf in batches:
            xy = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
            rows, at = [], [[], []]
            for n, ends in enumerate(xy):
                cuts = [0.0, 1.0]
                for k in (0, 1):
                    p, q = sorted((ends[k], ends[k + 2]))
                    if p < q:
                        lines = np.arange(np.ceil(p / size), np.floor(q / size) + 1) * size
                        cuts += [t for t in (lines - ends[k]) / (ends[k + 2] - ends[k]) if 0 < t < 1]
                cuts.sort()
                parts = [(t, u) for t, u in zip(cuts, cuts[1:]) if t < u]
                rows += [n] * len(parts)
                for k in (0, 1):
                    at[k] += [x[k] for x in parts]
            t, u, s = np.array(at[0], float), np.array(at[1], float), xy[rows]
            out = pdf[["id", "seg"]].iloc[rows].reset_index(drop=True)
            d = s[:, 2:] - s[:, :2]
            a, b = s[:, :2] + t[:, None] * d, s[:, :2] + u[:, None] * d
            cells = np.floor((a + b) / 2 / size).astype("int64")
            yield out.assign(x0=a[:, 0], y0=a[:, 1], x1=b[:, 0], y1=b[:, 1], lo=t * np.hypot(d[:, 0], d[:, 1]), hi=u * np.hypot(d[:, 0], d[:, 1]), cx=cells[:, 0], cy=cells[:, 1])

    return work


def _covered(r: float):
    def work(batches):
        for pdf in batches:
            lo, hi = covered_interval(pdf[["x0", "y0", "x1", "y1"]].to_numpy(), pdf[["u0", "v0", "u1", "v1"]].to_numpy(), r)
            out = pdf[["id", "seg"]].assign(lo=pdf["lo"] + lo, hi=pdf["lo"] + hi)
            yield out[out["lo"] < out["hi"]]

    return work


def line_coverage(lines: DataFrame, others: DataFrame, radius: float, size: float) -> DataFrame:
    """Length of each line (id, seg, x0, y0, x1, y1) within ``radius`` of any segment of ``others`` (id, seg, x0, y0, x1, y1) with another id: id, length, covered.

    Segments are cut at cells so small (``size`` at most) that all of a cell is within the
    radius of whatever touches it.  A piece whose cell holds another id is covered whole;
    only the pieces alone in their cell are tested one by one with pieces around them.
    """
    from .sequences import interval_union

    side = min(size, radius / 1.5)
    reach = int(np.ceil(radius / side))
    kind = dict(lines.dtypes)
    ends = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    known = "x0 + y0 + x1 + y1 is not null"
    form = "x0 double, y0 double, x1 double, y1 double, lo double, hi double, cx long, cy long"
    cut = lambda df: df.filter(known).select("id", "seg", *ends).mapInPandas(_pieces(side), f"id {kind['id']}, seg {kind['seg']}, {form}")
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    s = lines.withColumn("len", length).filter("len > 0")
    held = cut(others)
    cells = held.groupBy("cx", "cy").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    met = cut(s).join(cells, ["cx", "cy"], "left").withColumn("full", F.coalesce((F.col("first") != F.col("id")) | (F.col("last") != F.col("id")), F.lit(False)))
    whole = met.filter("full").select("id", "seg", "lo", "hi")
    shift = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    around = met.filter("not full").select("id", "seg", "x0", "y0", "x1", "y1", "lo", "cx", "cy")
    around = around.withColumn("dx", F.explode(shift)).withColumn("dy", F.explode(shift)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")
    t = held.select(F.col("id").alias("t_id"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), "cx", "cy")
    near = around.join(t, ["cx", "cy"]).filter(F.col("id") != F.col("t_id")).drop("cx", "cy", "t_id").mapInPandas(_covered(radius), f"id {kind['id']}, seg {kind['seg']}, lo double, hi double")
    merged = interval_union(whole.unionByName(near).withColumn("k", F.struct("id", "seg")), "k", "lo", "hi").groupBy(F.col("k.id").alias("c_id")).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    total = s.groupBy("id").agg(F.sum("len").alias("length"))
    return total.join(merged, F.col("id") == F.col("c_id"), "left").select("id", "length", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def shoelace(ring: Column) -> Column:
    """Area of a closed ring of (x, y) structs."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2


def interpolate_at(line: Column, share: Column) -> Column:
    """The point at a share (0 to 1) of a line's length; line: array of (x, y)."""
    legs = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: F.sqrt(F.pow(F.get(line, i + 1)["x"] - F.get(line, i)["x"], 2) + F.pow(F.get(line, i + 1)["y"] - F.get(line, i)["y"], 2)))
    total = F.aggregate(legs, F.lit(0.0), lambda a, b: a + b)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(s, leg):
        want = share * total
        t = F.when(leg == 0, F.lit(0.0)).otherwise(F.greatest(F.least((want - s["done"]) / leg, F.lit(1.0)), F.lit(0.0)))
        a, b = F.get(line, s["i"]), F.get(line, s["i"] + 1)
        here = s["x"].isNull() | (want > s["done"])
        return F.struct((s["i"] + 1).alias("i"), (s["done"] + leg).alias("done"), F.when(here, a["x"] + t * (b["x"] - a["x"])).otherwise(s["x"]).alias("x"), F.when(here, a["y"] + t * (b["y"] - a["y"])).otherwise(s["y"]).alias("y"))

    end = F.aggregate(legs, start, walk)
    return F.struct(end["x"].alias("x"), end["y"].alias("y"))
