"""Flow networks that split and meet: chains contracted first, then widest paths, levels and flux, cycles included.

Connected parts of at most ``WHOLE`` edges are solved many at once in a task (``parts``).  Larger
ones take rounds over their edges.  Most nodes of such a network have one edge in and one out:
``contract`` folds these chains in log2(length) joins, so that the rounds are those of the forks alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from .graph import CycleError, climb
from .iterate import Layers, cut, plain_plans, settle
from .parts import Outward, in_parts, numbered, solve, split

#: Costs and lengths are summed in whole parts of this size, so that sums and ties do not hang on their order.
PARTS = 10**6
#: The most edges of a part that is solved in a task; for flux, which solves a dense system, of so many.
WHOLE, DENSE = 4096, 256


def contract(edges: DataFrame, folds: dict[str, Callable[[Column, Column], Column]], keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between forks (src, dst, folded values), and the nodes inside chains (id, head, folded values from the head).

    ``edges`` (src, dst, and a column for each of ``folds``, which must not hang on order) may
    repeat.  A node is inside a chain if one edge enters it, one leaves it and ``keep`` (id)
    lacks it.  Rings of such nodes alone have no head and are left out: nothing outside
    reaches them.  Edges with a null end are left out.
    """
    rows = settle(edges.select("src", "dst", *folds).filter("src IS NOT NULL AND dst IS NOT NULL"))
    one_in = rows.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).filter("n = 1").select("id")
    one_out = rows.groupBy(F.col("src").alias("_o")).agg(F.count("*").alias("n")).filter("n = 1").select("_o")
    inside = cut(one_in.join(one_out, F.col("id") == F.col("_o"), "left_semi").join(keep.select(F.col("id").alias("_k")), F.col("id") == F.col("_k"), "left_anti"))
    into = rows.join(inside, F.col("dst") == F.col("id"), "left_semi")
    # Names are structs: to ``climb`` a plain 0 is an end.
    steps = into.select(F.struct("dst").alias("id"), F.struct(F.col("src").alias("dst")).alias("next"), *folds)
    walked = climb(steps, {k: F.col(k) for k in folds}, folds, rings=True)
    chains = settle(walked.select(F.col("id.dst").alias("id"), F.col("hop.dst").alias("head"), *folds))
    last = rows.join(inside, F.col("dst") == F.col("id"), "left_anti")
    plain = last.join(inside, F.col("src") == F.col("id"), "left_anti")
    before = chains.select(F.col("id").alias("_i"), F.col("head").alias("_head"), *[F.col(k).alias(f"_{k}") for k in folds])
    long = last.join(before, F.col("src") == F.col("_i")).select(F.col("_head").alias("src"), "dst", *[f(F.col(k), F.col(f"_{k}")).alias(k) for k, f in folds.items()])
    return settle(plain.select("src", "dst", *folds).unionByName(long)), chains


def _relax(edges: DataFrame, best: DataFrame, extend: Callable[[], Column]) -> DataFrame:
    """Least label m of every node that edges reach from ``best`` (id, m); ``extend`` is the label over an edge, never less than m."""
    frontier = best = settle(best)
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), extend().alias("m")).groupBy("id").agg(F.min("m").alias("m"))
        known = best.select("id", F.col("m").alias("old"))
        frontier = settle(step.join(known, "id", "left").filter("old IS NULL OR m < old").select("id", "m"))
        best = settle(best.unionByName(frontier).groupBy("id").agg(F.min("m").alias("m")))
    return best


#: Marks of ids: rows start there, rows are wanted there.
START, WANTED = 1, 2


def _with_starts(edges: DataFrame, starts: DataFrame, most: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of small parts (edges, and marked ids as rows without dst), edges of large ones, their starts, and starts that no edge meets.

    ``starts`` (id, ...) and ``wanted`` (id) have no null ids, and a start no second row.
    """
    marks = starts.select("id", F.lit(START).alias("mark"))
    if wanted is not None:
        marks = marks.unionByName(wanted.select("id", F.lit(WANTED).alias("mark")))
    rows, held = in_parts(edges, marks)
    small, large, which = split(rows, most)
    begin = held.filter("mark > 0")
    if starts.columns != ["id"]:
        begin = settle(begin.join(starts, "id", "left"))
    alone = begin.filter("part IS NULL").drop("part")
    begin = begin.filter("part IS NOT NULL")
    within = begin.filter("false") if which is None else begin.join(which, "part", "left_semi")
    begin = begin if which is None else begin.join(which, "part", "left_anti")
    is_start = F.col("mark").bitwiseAND(START) > 0
    return small.unionByName(begin.withColumnRenamed("id", "src"), allowMissingColumns=True), large.drop("part"), within.filter(is_start).select(starts.columns), alone.filter(is_start)


def _ends(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Table, pa.Table]:
    """Names of all nodes in order, src and dst of the edges, the nodes that rows without dst name, and the rows of both."""
    is_edge = t["dst"].is_valid()
    e, put = t.filter(is_edge), t.filter(pc.invert(is_edge))
    names, (src, dst, begin) = numbered(e["src"], e["dst"], put["src"])
    return names, src, dst, begin, e, put


def _widest_of(t: pa.Table, only_wanted: bool) -> pa.Table:
    """``widest`` over small parts, of all nodes or the wanted ones: widths by rounds of max-min from the nodes that grew, then least labels on the edges that keep them."""
    names, src, dst, marked, e, put = _ends(t)
    mark = put["mark"].to_numpy()
    begin = marked[mark & START > 0]
    n, width = len(names), e["width"].to_numpy()
    sums = np.stack([e[c].to_numpy() for c in ("cost", "length", "shortcuts")])
    out, w = Outward(src, n), np.full(n, -np.inf)
    w[begin] = np.inf
    front = np.unique(begin)
    while len(front):
        step = out.of(front)
        old = w.copy()
        np.maximum.at(w, dst[step], np.minimum(w[src[step]], width[step]))
        front = np.flatnonzero(w > old) if len(step) > n // 8 else np.unique(dst[step][w[dst[step]] > old[dst[step]]])
    reached = np.zeros(n, bool)
    reached[begin] = True
    best = np.zeros((4, n), np.int64)  # cost, length, shortcuts, source
    best[3, begin] = begin
    tight = np.minimum(w[src], width) == w[dst]
    front = np.unique(begin)
    while len(front):
        step = out.of(front)
        step = step[tight[step]]
        to = dst[step]
        new = np.vstack([best[:3, src[step]] + sums[:, step], best[3, src[step]]])
        order = np.lexsort((*new[::-1], to))
        to, new = to[order], new[:, order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        to, new = to[first], new[:, first]
        less = np.zeros(len(to), bool)
        for k in reversed(range(4)):
            less = (new[k] < best[k, to]) | ((new[k] == best[k, to]) & less)
        less |= ~reached[to]
        front = to[less]
        best[:, front], reached[front] = new[:, less], True
    if only_wanted:
        wanted = np.zeros(n, bool)
        wanted[marked[mark & WANTED > 0]] = True
        reached &= wanted
    at = np.flatnonzero(reached)
    return pa.table({"id": names.take(pa.array(at)), "source": names.take(pa.array(best[3, at])), "width": w[at], **{c: best[k, at] for k, c in enumerate(("cost", "length", "shortcuts"))}})


def widest(edges: DataFrame, starts: DataFrame, whole: int = WHOLE, wanted: DataFrame | None = None) -> DataFrame:
    """id, source, width, cost, length, shortcuts: of the paths from any of ``starts`` (id) to each node, the one whose least width is greatest.

    ``edges`` (src, dst, width, cost, length, shortcut boolean); a null width does not bound a
    path (connectors and passages through a reservoir), null costs and lengths are 0 and a
    null shortcut is none.  The path is chosen node by node: each node goes on from the widest
    path of the one before.  Of these the one with the least cost is taken, then the shortest,
    the one with fewest shortcuts, and the lowest source.  A start has width infinity.  Nodes
    that no start reaches, and repeated starts, give no further rows.  With ``wanted`` (id) only
    these nodes have rows: others are neither written nor joined.

    Widths are settled first, by rounds of max-min; the edges that keep them then make up a
    network on which least sums are found.  Parts of more than ``whole`` edges take a round
    an edge of the longest best path between forks for both.
    """
    part = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * PARTS).cast("long").alias(c)
    wide = F.coalesce(F.col("width").cast("double"), F.lit(float("inf"))).alias("width")
    rows = edges.select("src", "dst", wide, part("cost"), part("length"), F.coalesce(F.col("shortcut").cast("long"), F.lit(0).cast("long")).alias("shortcuts"))
    begin = starts.select("id").filter("id IS NOT NULL").distinct()
    wanted = None if wanted is None else wanted.select("id").filter("id IS NOT NULL")
    with plain_plans(edges.sparkSession):
        only_wanted = wanted is not None
        small, large, within, alone = _with_starts(rows, begin, whole, wanted)
        kind = rows.schema["src"].dataType
        schema = StructType().add("id", kind).add("source", kind).add("width", DoubleType()).add("cost", LongType()).add("length", LongType()).add("shortcuts", LongType())
        found = settle(solve(small, lambda t, _: _widest_of(t, only_wanted), schema))
        zero = F.lit(0).cast("long")
        alone = alone.filter(F.col("mark").bitwiseAND(WANTED) > 0) if only_wanted else alone
        found = found.unionByName(alone.select("id", F.col("id").alias("source"), F.lit(float("inf")).alias("width"), zero.alias("cost"), zero.alias("length"), zero.alias("shortcuts")))
        if not large.isEmpty():
            more = _widest_in_rounds(large, within)
            found = found.unionByName(more.join(wanted, "id", "left_semi") if only_wanted else more)
    return found.select("id", "source", "width", (F.col("cost") / PARTS).alias("cost"), (F.col("length") / PARTS).alias("length"), "shortcuts")


def _widest_in_rounds(rows: DataFrame, begin: DataFrame) -> DataFrame:
    """``widest`` in rounds over all ``rows``: costs and lengths in whole parts."""
    add = lambda a, b: a + b
    between, chains = contract(rows, {"width": F.least, "cost": add, "length": add, "shortcuts": add}, begin)
    # The negative width, so that the least label is the widest.
    widths = _relax(between, begin.select("id", F.lit(float("-inf")).alias("m")), lambda: F.greatest(F.col("m"), -F.col("width")))
    widths = widths.select("id", (-F.col("m")).alias("w"))
    at, to = widths.select(F.col("id").alias("_a"), F.col("w").alias("_wa")), widths.select(F.col("id").alias("_b"), F.col("w").alias("_wb"))
    tight = between.join(at, F.col("src") == F.col("_a")).join(to, F.col("dst") == F.col("_b"))
    tight = settle(tight.filter("least(_wa, width) = _wb").select("src", "dst", "cost", "length", "shortcuts"))
    zero = F.lit(0).cast("long")
    first = begin.select("id", F.struct(zero.alias("cost"), zero.alias("length"), zero.alias("shortcuts"), F.col("id").alias("source")).alias("m"))
    more = lambda: F.struct(*[(F.col(f"m.{c}") + F.col(c)).alias(c) for c in ("cost", "length", "shortcuts")], F.col("m.source").alias("source"))
    forks = settle(_relax(tight, first, more).join(widths, "id").select("id", "m.source", F.col("w").alias("width"), "m.cost", "m.length", "m.shortcuts"))
    head = forks.select(F.col("id").alias("_h"), "source", *[F.col(c).alias(f"_{c}") for c in ("width", "cost", "length", "shortcuts")])
    within = chains.join(head, F.col("head") == F.col("_h")).select("id", "source", F.least("width", "_width").alias("width"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("cost", "length", "shortcuts")])
    return forks.unionByName(within).select("id", "source", "width", "cost", "length", "shortcuts")


def linked_ends(edges: DataFrame, starts: DataFrame, ends: DataFrame, least_width: float, most_share: float, least_length: Column) -> DataFrame:
    """id, source, width, cost, length, shortcuts, share, reason: how each of ``ends`` is linked with the starts.

    ``cost`` is the length on connectors and ``share`` its part of the whole.  ``reason`` is the
    first gate that fails: ``unreached`` (or a start itself), ``narrow``, ``connectors`` or
    ``short``; null where all hold.  ``least_length`` may use columns of ``ends``.
    """
    found = widest(edges, starts, wanted=ends).withColumnRenamed("id", "_id")
    share = F.when(F.col("length") > 0, F.col("cost") / F.col("length")).otherwise(F.lit(0.0))
    reason = F.when(F.col("_id").isNull() | (F.col("length") <= 0), "unreached").when(F.col("width") < least_width, "narrow").when(F.col("share") > most_share, "connectors").when(F.col("length") < F.col("_least"), "short")
    rows = ends.select("id", least_length.alias("_least")).join(found, F.col("id") == F.col("_id"), "left").withColumn("share", F.when(F.col("_id").isNotNull(), share)).withColumn("reason", reason)
    return rows.select("id", "source", "width", "cost", "length", "shortcuts", "share", "reason")


def _levels_of(t: pa.Table, _part: np.ndarray) -> pa.Table:
    """``levels`` over small parts, by peeling; null on and above cycles."""
    names, src, dst, _, _, _ = _ends(t)
    n = len(names)
    out, level, into = Outward(src, n), np.zeros(n, np.int64), np.bincount(dst, minlength=n)
    front = np.flatnonzero(into == 0)
    while len(front):
        step = out.of(front)
        np.maximum.at(level, dst[step], level[src[step]] + 1)
        np.subtract.at(into, dst[step], 1)
        front = np.unique(dst[step][into[dst[step]] == 0])
    return pa.table({"id": names, "level": pa.array(level, mask=into > 0)})


def levels(edges: DataFrame, nodes: DataFrame, whole: int = WHOLE) -> DataFrame:
    """id, level: edges on the longest path to each node of ``nodes`` (id) along ``edges`` (src, dst) between them; a cycle raises.

    Parts of more than ``whole`` edges take as many rounds as forks on such a path.
    """
    with plain_plans(edges.sparkSession):
        marks = nodes.select("id", F.lit(WANTED).alias("mark"))
        rows, held = in_parts(edges.select("src", "dst"), marks)
        small, large, which = split(rows, whole)
        found = settle(solve(small, _levels_of, StructType().add("id", rows.schema["src"].dataType).add("level", LongType())))
        if not found.filter("level IS NULL").isEmpty():
            raise CycleError("the network has a cycle")
        if which is not None:
            found = found.unionByName(_levels_in_rounds(large.drop("part"), held.join(which, "part", "left_semi").select("id")))
        if not (others := held.filter("mark = 0")).isEmpty():
            found = found.join(others, "id", "left_anti")
    return found.unionByName(held.filter("part IS NULL").select("id", F.lit(0).cast("long").alias("level")))


def _levels_in_rounds(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``levels`` of all ends ``ids`` of ``rows``, a round a fork."""
    left, chains = contract(rows.select("src", "dst", F.lit(1).cast("long").alias("n")), {"n": lambda a, b: a + b}, ids.filter("false"))
    inner = chains.select("id")
    # What an edge enters is a fork or inside a chain, but for rings that ``contract`` leaves out.
    entered = rows.select(F.col("dst").alias("id")).join(left.select(F.col("dst").alias("id")), "id", "left_anti")
    if not entered.join(inner, "id", "left_anti").isEmpty():
        raise CycleError("the network has a ring")
    forks = ids.join(inner, "id", "left_anti")
    done, open_ = Layers(rows.sparkSession), settle(forks.withColumn("level", F.lit(0).cast("long")))
    while not open_.isEmpty():
        free = done.add(open_.join(left.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            raise CycleError("the network has a cycle")
        out = free.select(F.col("id").alias("src"), "level").join(left, "src")
        reached = out.groupBy(F.col("dst").alias("_d")).agg(F.max(F.col("level") + F.col("n")).alias("_l"))
        rest = open_.join(free.select("id"), "id", "left_anti")
        left = settle(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        open_ = settle(rest.join(reached, F.col("id") == F.col("_d"), "left").select("id", F.greatest("level", "_l").alias("level")))
    found = done.read(forks.withColumn("level", F.lit(0).cast("long")).schema)
    head = found.select(F.col("id").alias("head"), "level")
    within = chains.join(head, "head").select("id", (F.col("level") + F.col("n")).alias("level"))
    return found.unionByName(within)


def _flux_of(t: pa.Table, part: np.ndarray) -> pa.Table:
    """``solve_flux`` over small parts: dense systems of the nodes that sources reach, stacked by size; NaN where one has no solution."""
    names, src, dst, begin, e, put_in = _ends(t)
    n, share = len(names), e["share"].to_numpy()
    is_edge = t["dst"].is_valid().to_numpy()
    put, of = np.zeros(n), np.zeros(n, np.int64)
    put[begin] = put_in["r"].to_numpy()
    of[src], of[dst] = part[is_edge], part[is_edge]
    out, seen, front = Outward(src, n), np.zeros(n, bool), np.unique(begin)
    while len(front):
        seen[front] = True
        to = dst[out.of(front)]
        front = np.unique(to[~seen[to]])
    at = np.flatnonzero(seen)
    at = at[np.argsort(of[at], kind="stable")]
    first = np.flatnonzero(np.diff(of[at], prepend=-1))
    size = np.diff(first, append=len(at))
    system, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    system[at] = np.repeat(np.arange(len(size)), size)
    place[at] = np.arange(len(at)) - np.repeat(first, size)
    edge = np.flatnonzero(seen[src])
    edge = edge[np.argsort(system[src[edge]], kind="stable")]
    upto = np.searchsorted(system[src[edge]], np.arange(len(size) + 1))
    flux = np.zeros(n)
    wide = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for k in np.unique(wide):
        chosen = np.flatnonzero(wide == k)
        for some in np.array_split(chosen, len(chosen) * k * k // 2**21 + 1):
            slot = np.zeros(len(size), np.int64)
            slot[some] = np.arange(len(some))
            nodes = at[np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())]
            many = upto[some + 1] - upto[some]
            own = edge[np.repeat(upto[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            a, b = np.tile(np.eye(k), (len(some), 1, 1)), np.zeros((len(some), k, 2))
            np.add.at(a, (slot[system[src[own]]], place[dst[own]], place[src[own]]), -share[own])
            b[slot[system[nodes]], place[nodes]] = np.stack([put[nodes], np.abs(put[nodes])], axis=1)
            x = _solved(a, b)
            # What is put in without its sign shows cycles that keep all or give more than they get.
            total = b[:, :, 1].sum(axis=1)[:, None]
            bad = ~((x[:, :, 1] >= -1e-9 * total) & (x[:, :, 1] <= 1e12 * total)).all(axis=1)
            x[bad] = np.nan
            flux[nodes] = x[slot[system[nodes]], place[nodes], 0]
    return pa.table({"id": names.take(pa.array(at)), "flux": flux[at]})


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems, NaN where one has none."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full_like(b, np.nan)
        half = len(a) // 2
        return np.concatenate([_solved(a[:half], b[:half]), _solved(a[half:], b[half:])])


def solve_flux(edges: DataFrame, sources: DataFrame, least: float = 1e-12, rounds: int = 500, whole: int = DENSE) -> DataFrame:
    """id, flux: what ``sources`` (id, amount) put in, handed on along ``edges`` (src, dst, share); cycles are allowed.

    This solves x = shares x + amounts.  Parts of at most ``whole`` edges are solved as they are,
    and raise where a source reaches a cycle that keeps all it gets.  In larger ones what has
    not been handed on yet moves an edge a round
    (between forks: chains are contracted) and is added up; the rounds end when at most
    ``least`` in all is still moving, and that is the residual of what is returned.  The
    shares of a node must not be negative or add up to more than 1, then what moves never grows.
    On a cycle that hands the part p of its inflow round again it falls by p a turn, so some
    log(least) / log(p) turns are needed; beyond ``rounds`` the run raises, as it does
    where a cycle keeps all it gets.  Amounts of a repeated source add up; nodes that nothing
    reaches have no row.
    """
    put = sources.filter("id IS NOT NULL AND amount <> 0").groupBy("id").agg(F.sum(F.col("amount").cast("double")).alias("r"))
    rows = edges.select("src", "dst", F.col("share").cast("double").alias("share")).filter("share <> 0")
    with plain_plans(edges.sparkSession):
        small, large, within, alone = _with_starts(rows, put, whole)
        found = settle(solve(small, _flux_of, StructType().add("id", rows.schema["src"].dataType).add("flux", DoubleType())))
        if not found.filter("isnan(flux)").isEmpty():
            raise CycleError("the flux of a cycle did not settle")
        found = found.unionByName(alone.select("id", F.col("r").alias("flux")))
        if not large.isEmpty():
            found = found.unionByName(_flux_in_rounds(large, within, least, rounds))
    return found


def _flux_in_rounds(rows: DataFrame, put: DataFrame, least: float, rounds: int) -> DataFrame:
    """``solve_flux`` by rounds over all ``rows``."""
    passed = Layers(rows.sparkSession)
    put = moving = passed.add(put)
    between, chains = contract(rows, {"share": lambda a, b: a * b}, put)
    between = settle(between.groupBy("src", "dst").agg(F.sum("share").alias("share")))
    for _ in range(rounds):
        moving = passed.add(moving.join(between, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("share")).alias("r")))
        if (moving.agg(F.sum(F.abs("r"))).head()[0] or 0.0) <= least:
            break
    else:
        raise CycleError("the flux of a cycle did not settle")
    forks = settle(passed.read(put.schema).groupBy("id").agg(F.sum("r").alias("flux")))
    head = forks.select(F.col("id").alias("head"), "flux")
    within = chains.join(head, "head").select("id", (F.col("flux") * F.col("share")).alias("flux"))
    return forks.unionByName(within)
