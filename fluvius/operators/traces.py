"""Traces of one name up a flow tree, and ranks handed on between touching pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import climb, subtree_max
from .iterate import cut, plain_plans, settle
from .spatial import nearest_anywhere

#: Evidence is summed in whole parts of this size, so that sums and ties do not hang on their order.
UNITS = 10**9


def _add(a, b):
    return a + b


def name_trace(nodes: DataFrame, starts: DataFrame, max_gap: int, free_lead: bool = False) -> DataFrame:
    """trace, id, place, evidence: the reaches of each trace from its start upwards; evidence is summed from the start.

    ``nodes`` (trace, id, next, kind, evidence, area) class each reach against the name that
    the trace follows; next 0 or null is the end below.  ``starts`` (trace, id) has one start
    a trace.  Only a ``strong`` reach may end a trace.  Between strong ones there may be any
    number of ``weak`` and ``lake`` reaches and ``max_gap`` others (``gap``, null) in all;
    ``blocked`` ones are never entered.  At a fork the branch with the most evidence (of
    strong and weak reaches, not negative, in parts of 1e-9) goes on, then the one with the
    larger area, then the lower id.  With ``free_lead``, gaps before the first strong reach
    above a start that is not strong are not counted.  A start is kept whatever it is; one
    that ``nodes`` lacks has no trace.

    As evidence adds up along a path, the best branch at every fork is the one to the end
    with the greatest sum from the start.  So each step is a fold along paths or a maximum
    over what is above, in log2(depth) joins, for all traces at once; a cycle raises.
    """
    kind = F.coalesce(F.col("kind"), F.lit("gap"))
    own = F.when(kind.isin("strong", "weak"), F.round(F.coalesce("evidence", F.lit(0.0)) * UNITS).cast("long")).otherwise(F.lit(0).cast("long"))
    below = F.when(F.col("next") != 0, F.struct("trace", F.col("next").alias("id")))
    place = F.struct("trace", "id")
    rows = nodes.select(place.alias("id"), below.alias("next"), kind.alias("kind"), F.coalesce(F.col("area").cast("double"), F.lit(float("-inf"))).alias("area"), own.alias("own"))
    first = starts.select(place.alias("_s")).distinct()
    with plain_plans(nodes.sparkSession):
        rows = rows.join(first, F.col("id") == F.col("_s"), "left").withColumn("start", F.col("_s").isNotNull()).drop("_s")
        rows = settle(rows.join(starts.select("trace").distinct(), F.col("id.trace") == F.col("trace"), "left_semi"))
        begin = rows.filter("start")
        seen = climb(rows, {"gaps": (F.col("kind") == "gap").cast("long")}, {"gaps": _add}, until=(F.col("kind") == "strong") | F.col("start"))
        lead = begin.filter(F.lit(free_lead) & (F.col("kind") != "strong")).select(F.col("id").alias("_lead"))
        seen = seen.join(lead, F.col("hop") == F.col("_lead"), "left").select(F.col("id").alias("_i"), ((F.col("gaps") <= max_gap) | F.col("_lead").isNotNull()).alias("_near"))
        entered = (F.col("kind") == "strong") | ((F.col("kind") != "blocked") & F.col("_near"))
        walk = rows.join(seen, F.col("id") == F.col("_i")).select("id", "next", "start", "own", entered.alias("ok"))
        both = {"ok": F.col("ok"), "sum": F.col("own"), "place": F.lit(1).cast("long")}
        walk = climb(walk, both, {"ok": lambda a, b: a & b, "sum": _add, "place": _add}, until=F.col("start")).filter("ok")
        root = begin.select(F.col("id").alias("_root"), F.col("own").alias("_own"))
        walk = walk.join(root, F.col("hop") == F.col("_root")).select(F.col("id").alias("_i"), "sum", "place", "_own")
        reached = settle(rows.filter("NOT start").join(walk, F.col("id") == F.col("_i")).drop("_i"))
        best = subtree_max(reached.withColumn("end", F.when(F.col("kind") == "strong", F.col("sum"))), "end").filter("best IS NOT NULL")
        open_ = settle(reached.join(best.select(F.col("id").alias("_i"), "best"), F.col("id") == F.col("_i")).drop("_i"))
        taken = open_.groupBy("next").agg(F.max_by("id", F.struct("best", "area", -F.col("id.id"))).alias("_i")).select("_i")
        ways = open_.join(taken, F.col("id") == F.col("_i"), "left").select("id", "next", F.col("_i").isNotNull().alias("on"))
        on = climb(ways, {"on": F.col("on")}, {"on": lambda a, b: a & b}).filter("on").select(F.col("id").alias("_i"))
        above = open_.join(on, F.col("id") == F.col("_i"), "left_semi").select("id", "place", (F.col("sum") + F.col("_own")).alias("sum"))
        out = above.unionByName(begin.select("id", F.lit(0).cast("long").alias("place"), F.col("own").alias("sum")))
        return settle(out.select("id.trace", "id.id", "place", (F.col("sum") / UNITS).alias("evidence")))


def highest_near(points: DataFrame, others: DataFrame, radius: float, by: list[str], rank: str, enough: int = 16, deepest: int = 8) -> DataFrame:
    """id, top: the largest ``rank`` of ``others`` (x, y, rank) within ``radius`` of any of the points (id, x, y), equal in ``by``; ids that reach none are left out.

    ``top`` is null where all that are reached have none.  No pairs are made where points lie
    densely: of two grid cells that lie within the radius as a whole, the cell's largest rank
    counts for all points of the other.  Cells on the rim of the radius are looked into only
    where they hold more than that; they are halved until their points make up no more than
    ``enough`` pairs a point, or ``deepest`` times, and then points are compared.
    """
    size = radius / 4
    finite = "abs(x) < double('infinity') and abs(y) < double('infinity')"
    at = lambda level: [F.floor(F.col(c) / (size / 2**level)).cast("long") for c in ("x", "y")]
    asked = settle(points.select("id", *by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite))
    # A struct, so that a rank that is null comes after all others, and none at all is null.
    top = F.struct(F.col(rank).isNotNull().alias("known"), F.col(rank).alias("rank"))
    held = others.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), top.alias("top")).filter(finite)
    held = settle(held.groupBy(*by, "x", "y").agg(F.max("top").alias("top")))
    most = enough * (asked.count() + held.count())
    found, rim, level = [], None, 0
    while True:
        x, y = at(level)
        to = asked.groupBy(*by, x.alias("qx"), y.alias("qy")).agg(F.count(F.lit(1)).alias("n"))
        of = held.groupBy(*by, x.alias("hx"), y.alias("hy")).agg(F.max("top").alias("top"))
        if rim is None:
            steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-5, 6) for j in range(-5, 6)])
            of = of.select("*", F.explode(steps).alias("_s")).select(*of.columns, (F.col("hx") + F.col("_s.i")).alias("qx"), (F.col("hy") + F.col("_s.j")).alias("qy"))
            met = of.join(to, [*by, "qx", "qy"]).withColumn("sure", F.lit(None).cast(held.schema["top"].dataType))
        else:
            half = lambda rows, *cs: rows.select("*", *[F.shiftright(c, 1).alias(f"_{c}") for c in cs])
            met = rim.withColumnsRenamed({c: f"_{c}" for c in ("qx", "qy", "hx", "hy")}).join(half(to, "qx", "qy"), [*by, "_qx", "_qy"]).join(half(of, "hx", "hy"), [*by, "_hx", "_hy"])
        i, j = F.abs(F.col("qx") - F.col("hx")), F.abs(F.col("qy") - F.col("hy"))
        reach, outer, inner = (4 * 2**level) ** 2, (i + 1) * (i + 1) + (j + 1) * (j + 1), F.pow(F.greatest(i - 1, F.lit(0)), 2) + F.pow(F.greatest(j - 1, F.lit(0)), 2)
        # Far from the origin a cell's rounding is no longer small against it.
        whole = (outer <= reach * (1 - 1e-6)) & (F.greatest(F.abs("qx"), F.abs("qy")) < 2**30)
        met = settle(met.filter(inner <= reach * (1 + 1e-6)).select(*by, "qx", "qy", "n", "hx", "hy", "top", "sure", whole.alias("whole")))
        new = met.filter("whole").groupBy(*by, "qx", "qy").agg(F.max("top").alias("_new"))
        found.append((level, new))
        rim = met.filter("NOT whole").join(new, [*by, "qx", "qy"], "left").withColumn("sure", F.greatest("sure", "_new")).filter("sure IS NULL OR top > sure")
        rim = settle(rim.select(*by, "qx", "qy", "n", "hx", "hy", "sure"))
        open_ = held.select(*by, x.alias("hx"), y.alias("hy"), F.col("x").alias("_x"), F.col("y").alias("_y"), "top").join(rim, [*by, "hx", "hy"]).filter("sure IS NULL OR top > sure")
        if level == deepest or (open_.agg(F.sum("n")).head()[0] or 0) <= most:
            break
        rim, level = rim.drop("n"), level + 1
    near = asked.withColumn("qx", x).withColumn("qy", y).join(open_.select(*by, "qx", "qy", "_x", "_y", "top"), [*by, "qx", "qy"])
    out = near.filter(F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)) <= radius).select("id", "top")
    for level, sure in found:
        x, y = at(level)
        out = out.unionByName(asked.withColumn("qx", x).withColumn("qy", y).join(sure, [*by, "qx", "qy"]).select("id", F.col("_new").alias("top")))
    return out.groupBy("id").agg(F.max("top").alias("top")).select("id", F.col("top.rank").alias("top"))


def spread_ranks(pieces: DataFrame, ends: DataFrame, snap: float, extent: float) -> DataFrame:
    """id, rank, layer, dist: ranks of ``pieces`` (id, grp, ranked, rank) after those without one of their own took a neighbour's.

    ``ends`` (id, x, y) are all ends of all parts, in metres; pieces of one group touch
    within ``snap``.  A ranked piece, and one without a group, keeps its rank (layer 0).
    Layer by layer, an open piece takes the largest rank of the settled ones it touches, if
    that is above its own.  One that no chain reaches (layer null) takes the rank of the
    settled piece of its group with the nearest end, ``dist`` away (ties: the lowest id), by
    the same rule; dist is null where its group has none within ``extent``.  Null ``ranked``
    counts as not ranked.  A layer takes joins by id and by cell of the pieces not yet settled; no
    pairs of touching pieces are made (``highest_near``).
    """
    ranked = F.col("grp").isNull() | F.coalesce("ranked", F.lit(False))
    with plain_plans(pieces.sparkSession):
        rows = cut(pieces.select("id", "grp", "rank", ranked.alias("done")))
        spots = cut(ends.join(rows.filter("grp IS NOT NULL").select("id", "grp"), "id").select("id", "grp", "x", "y"))
        front = rows.filter("done").select("id", "rank", F.lit(0).alias("layer"))
        layers, left, layer = [front], rows.filter("NOT done").select("id", "rank"), 0
        while True:
            layer += 1
            heard = highest_near(spots.join(left.select("id"), "id", "left_semi"), spots.join(front.select("id", "rank"), "id"), snap, ["grp"], "rank")
            front = settle(left.join(heard, "id").select("id", F.greatest("rank", "top").alias("rank"), F.lit(layer).alias("layer")))
            if front.isEmpty():
                break
            layers.append(front)
            left = settle(left.join(front.select("id"), "id", "left_anti"))
        settled = layers[0]
        for part in layers[1:]:
            settled = settled.unionByName(part)
        settled = cut(settled)
        side = lambda of, s: spots.join(of.select("id"), "id", "left_semi").select(F.col("id").alias(f"id{s}"), "grp", F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
        met = nearest_anywhere(side(left, "a"), side(settled, "b"), snap, extent, ["grp"])
        met = met.join(settled.select(F.col("id").alias("idb"), F.col("rank").alias("_r")), "idb").select(F.col("ida").alias("id"), "_r", "dist")
        rest = left.join(met, "id", "left").select("id", F.greatest("rank", "_r").alias("rank"), F.lit(None).cast("int").alias("layer"), "dist")
        return settled.withColumn("dist", F.lit(None).cast("double")).unionByName(rest)
