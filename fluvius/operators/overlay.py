"""Polygon overlay: union, intersection and difference from an arrangement of edges, stitched into rings.

Edges on one stretch are put together, with the difference they make between their sides.  What
is left is cut at every crossing and touch, found by a join on grid cells.  For each piece it is
counted how many polygons of either layer lie on its left and right; pieces on whose
sides the wanted rule differs are the outline of the result.  Rings are stitched by the next
edge clockwise around their points, and numbered by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import cycle_order
from .iterate import cut

END = ("x1", "y1", "x2", "y2")
#: How many polygons of layers 0 and 1 more lie left of an edge than right of it.
NET = ("n0", "n1")
#: Coordinates of computed crossings are rounded to so many digits, so that both edges have the same point.
DIGITS = 9


def ring_edges(points: DataFrame, keys: list[str], ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Points (keys, ring, seq, x, y) of open rings -> their edges (keys, x1, y1, x2, y2); edges without length go."""
    by = Window.partitionBy(*keys, ring).orderBy(seq)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    rows = points.select(*keys, F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), ahead("x").cast("double").alias("x2"), ahead("y").cast("double").alias("y2"))
    return rows.filter("x1 <> x2 or y1 <> y2")


def _span(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")))


def _in_cells(edges: DataFrame, cell: float) -> DataFrame:
    """A row an edge and cell (cx, cy) of its box."""
    rows = edges.withColumn("cx", _span(F.least("x1", "x2"), F.greatest("x1", "x2"), cell))
    return rows.withColumn("cy", _span(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))


def _turned(rows: DataFrame) -> DataFrame:
    """Edges (grp, x1, y1, x2, y2, n0, n1) turned to the right or, where upright, up: the counts of those turned around change sign."""
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(END, ("x2", "y2", "x1", "y1"), strict=True)]
    return rows.select("grp", *ends, *[F.when(ahead, F.col(n)).otherwise(-F.col(n)).alias(n) for n in NET])


def _netted(rows: DataFrame, *key: str) -> DataFrame:
    """One row a key, with the sums of both counts; rows that cancel out go."""
    return rows.groupBy(*key).agg(*[F.sum(n).alias(n) for n in NET]).filter("n0 <> 0 or n1 <> 0")


def merged(edges: DataFrame) -> DataFrame:
    """Edges (grp, layer, poly, x1, y1, x2, y2) -> (grp, x1, y1, x2, y2, n0, n1): each stretch once.

    n0 and n1 say by how many polygons of layers 0 and 1 more lie left than right.  Level and
    upright edges are laid over each other along their lines, by sums from end to end; others
    are put together where both ends are equal.  Nothing is met in pairs here, so the work
    grows with the edges, however many lie on one stretch.
    """
    one = [(F.col("layer") == k).cast("long").alias(n) for k, n in enumerate(NET)]
    rows = _turned(edges.select("grp", *END, *one))
    slanted = _netted(rows.filter("x1 <> x2 and y1 <> y2"), "grp", *END)
    level = F.col("y1") == F.col("y2")
    pick = lambda a, b: F.when(level, F.col(a)).otherwise(F.col(b))
    line = rows.filter("x1 = x2 or y1 = y2").select("grp", level.alias("level"), pick("y1", "x1").alias("at"), pick("x1", "y1").alias("p"), pick("x2", "y2").alias("q"), *NET)
    key = ["grp", "level", "at"]
    ends = _netted(line.select(*key, "p", *NET).unionByName(line.select(*key, F.col("q").alias("p"), *[(-F.col(n)).alias(n) for n in NET])), *key, "p")
    by = Window.partitionBy(*key).orderBy("p")
    runs = ends.select(*key, "p", F.lead("p").over(by).alias("q"), *[F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in NET]).filter("q is not null and (n0 <> 0 or n1 <> 0)")
    put = lambda a, b: F.when(F.col("level"), F.col(a)).otherwise(F.col(b))
    return slanted.unionByName(runs.select("grp", put("p", "at").alias("x1"), put("at", "p").alias("y1"), put("q", "at").alias("x2"), put("at", "q").alias("y2"), *NET))


def split(edges: DataFrame, cell: float) -> DataFrame:
    """Edges (grp, x1, y1, x2, y2, n0, n1) cut where they meet others of their group, each piece once, with its counts."""
    edges = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    mine = _in_cells(edges.select("grp", "id", *END), cell)
    other = mine.select(F.col("grp").alias("g"), F.col("id").alias("o"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), *[F.col(c).alias(f"o{c}") for c in END])
    boxes = (F.col("x1") <= F.col("ox2")) & (F.col("ox1") <= F.col("x2")) & (F.least("y1", "y2") <= F.greatest("oy1", "oy2")) & (F.least("oy1", "oy2") <= F.greatest("y1", "y2"))
    pairs = mine.join(other, (F.col("grp") == F.col("g")) & (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy")) & (F.col("id") != F.col("o")) & boxes)
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    cross = dx * ey - dy * ex
    qx, qy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    t, u = (qx * ey - qy * ex) / cross, (qx * dy - qy * dx) / cross
    # One of the two edges computes the crossing, so that both are cut at the same point.
    first = F.struct(*END) <= F.struct(*[F.col(f"o{c}") for c in END])
    px = F.when(first, F.col("x1") + t * dx).otherwise(F.col("ox1") + u * ex)
    py = F.when(first, F.col("y1") + t * dy).otherwise(F.col("oy1") + u * ey)
    inside = (cross != 0) & t.between(0, 1) & u.between(0, 1)
    crossing = F.when(inside, F.struct(F.round(px, DIGITS).alias("x"), F.round(py, DIGITS).alias("y")))
    on = lambda x, y: ((x - F.col("x1")) * dy == (y - F.col("y1")) * dx) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    touch = [F.when(on(F.col(f"ox{k}"), F.col(f"oy{k}")), F.struct(F.col(f"ox{k}").alias("x"), F.col(f"oy{k}").alias("y"))) for k in (1, 2)]
    end = lambda k: (F.col("p.x") == F.col(f"x{k}")) & (F.col("p.y") == F.col(f"y{k}"))
    met = pairs.select("id", *END, F.explode(F.array(F.when(cross != 0, crossing).otherwise(touch[0]), F.when(cross == 0, touch[1]))).alias("p")).filter(F.col("p").isNotNull() & ~end(1) & ~end(2)).select("id", "p.x", "p.y")
    own = edges.select("id", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(edges.select("id", F.col("x2").alias("x"), F.col("y2").alias("y")))
    stops = met.unionByName(own).select("id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).distinct().join(edges, "id")
    along = (F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy
    by = Window.partitionBy("id").orderBy(along, "x", "y")
    pieces = stops.select("grp", "x", "y", F.lead("x").over(by).alias("bx"), F.lead("y").over(by).alias("by"), *NET).filter("bx is not null")
    return _netted(_turned(pieces.select("grp", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), *NET)), "grp", *END)


def sides(edges: DataFrame, cell: float) -> DataFrame:
    """(grp, x1, y1, x2, y2, la, lb, ra, rb): pieces, and how many polygons of layers 0 and 1 lie left and right of each.

    ``edges`` (grp, layer, poly, x1, y1, x2, y2) have their polygon's inside on the left: outer rings counter-clockwise, holes clockwise.
    Pieces with as many polygons of each layer on either side bound nothing and are left out.

    How many polygons hold a point is the sum of the counts of the pieces that a way to it
    from outside crosses.  The way goes to the right along the lower side of a row of cells
    and then up to the middle of the piece: the first part sums whole cells, and only pieces
    of one cell are met one by one.  A point of the way is on the same side of a piece in both
    parts, as both ask the same product; points count as a little to the right and, much less, up.
    """
    at = cut(split(merged(edges), cell).withColumn("piece", F.monotonically_increasing_id()))
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    to = at.select("grp", "piece", mx.alias("mx"), my.alias("my"), F.floor(mx / cell).alias("cx"), F.floor(my / cell).alias("cy"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Above 0 where the point is left of (above) the piece.
    above = lambda x, y: dx * (y - F.col("y1")) - dy * (x - F.col("x1"))
    past = lambda x, y: F.when(dy > 0, above(x, y) <= 0).otherwise(above(x, y) >= 0)
    y0 = F.col("cy") * cell
    rows = at.filter("y1 <> y2").withColumn("cy", _span(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)).filter((F.least("y1", "y2") <= y0) & (y0 < F.greatest("y1", "y2")))
    k = F.floor((F.col("x1") + (y0 - F.col("y1")) / dy * dx) / cell)
    # The cell in which the row's side is crossed: past its right end for certain, not yet at its left end.
    rows = rows.withColumn("cx", F.when(past(k * cell, y0), k - 1).when(past((k + 1) * cell, y0), k).otherwise(k + 1))
    aside = rows.select("grp", "cx", "cy", "piece", *END, *[F.when(dy > 0, -F.col(n)).otherwise(F.col(n)).alias(n) for n in NET], F.lit(False).alias("up"))
    upward = _in_cells(at.filter("x1 < x2"), cell).select("grp", "cx", "cy", "piece", *END, *NET, F.lit(True).alias("up"))
    cells = ["grp", "cy", "cx"]
    held = aside.select(*cells, *NET).unionByName(to.select(*cells, *[F.lit(0).cast("long").alias(n) for n in NET])).groupBy(*cells).agg(*[F.sum(n).alias(n) for n in NET])
    left = Window.partitionBy("grp", "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(*cells, *[F.coalesce(F.sum(n).over(left), F.lit(0)).alias(f"b{n}") for n in NET])
    met = to.withColumnRenamed("piece", "mine").join(aside.unionByName(upward), cells)
    under = ((above(F.col("mx"), y0) < 0) | ((above(F.col("mx"), y0) == 0) & (dy > 0))) & (above(F.col("mx"), F.col("my")) > 0)
    crossed = F.when(F.col("up"), (F.col("piece") != F.col("mine")) & (F.col("x1") <= F.col("mx")) & (F.col("mx") < F.col("x2")) & under).otherwise(past(F.col("mx"), y0))
    way = met.filter(crossed).groupBy(F.col("mine").alias("piece")).agg(*[F.sum(n).alias(f"w{n}") for n in NET])
    done = at.join(to.join(base, cells).drop("grp"), "piece").join(way, "piece", "left")
    # The way ends on the right of the piece, or left of it where it was past the piece when it turned up.
    start = above(F.col("mx"), y0)
    right = (start < 0) | ((start == 0) & (dy > 0))
    count = lambda n: F.col(f"b{n}") + F.coalesce(f"w{n}", F.lit(0))
    lefts = [F.when(right, count(n) + F.col(n)).otherwise(count(n)).alias(f"l{c}") for n, c in zip(NET, "ab", strict=True)]
    rights = [F.when(right, count(n)).otherwise(count(n) - F.col(n)).alias(f"r{c}") for n, c in zip(NET, "ab", strict=True)]
    return done.select("grp", *END, *lefts, *rights)


RULES = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b == 0),
    "overlap": lambda a, b: a + b > 1,
}


def outline(counted: DataFrame, rule: str) -> DataFrame:
    """The directed edges (grp, x1, y1, x2, y2) around what ``rule`` keeps, with it on their left."""
    keep = RULES[rule]
    rows = counted.withColumn("l", keep(F.col("la"), F.col("lb"))).withColumn("r", keep(F.col("ra"), F.col("rb"))).filter("l <> r")
    return rows.select("grp", *[F.when(F.col("l"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(END, ("x2", "y2", "x1", "y1"), strict=True)])


def measure(edges: DataFrame) -> DataFrame:
    """(grp, area, length) of outlines; areas of holes count against those around them."""
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    return edges.groupBy("grp").agg(area.alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))


def rings(edges: DataFrame) -> DataFrame:
    """(grp, ring, seq, x, y) of an outline: at a point where several rings touch, each goes on along the inside it bounds."""
    edges = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    out = edges.select(F.col("grp").alias("g"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("id").alias("nxt"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("to"))
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    turn = F.pmod(back - F.col("to"), F.lit(6.283185307179586))
    met = edges.join(out, (F.col("grp") == F.col("g")) & (F.col("x2") == F.col("px")) & (F.col("y2") == F.col("py")))
    nxt = cut(met.groupBy("id").agg(F.min(F.struct(turn.alias("turn"), "nxt"))["nxt"].alias("nxt")))
    place = cycle_order(nxt).select(F.col("id").alias("c_id"), "ring", "seq")
    return edges.join(place, F.col("id") == F.col("c_id")).select("grp", "ring", "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
