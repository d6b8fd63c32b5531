"""Names and hierarchies: spelling corrections, votes, selections of identifiers, ancestor paths and depth-first order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import main_name
from ..functions.text import name_key
from .graph import climb
from .iterate import cut


def corrections(candidates: DataFrame, names: DataFrame, most: int = 2, least_share: float = 0.5) -> DataFrame:
    """display, name, share, distance: for names whose spelling another source has otherwise.

    ``candidates`` has display, name and share; ``names`` has display, all that are in use.
    Counted are candidates of at least ``least_share`` with as many words, whose key lies 1 to
    ``most`` edits away and is no key of another name in use.  The best has the fewest edits,
    then the largest share, then the lowest name.  A name that some candidate spells alike
    has no correction.
    """
    along = candidates.filter(F.col("share") >= least_share).select("display", "share", main_name(F.col("name")).alias("name"))
    along = along.select("*", name_key(F.col("display")).alias("k"), name_key(F.col("name")).alias("m"))
    alike = along.filter("k = m").select("display").distinct()
    used = names.select(name_key(F.col("display")).alias("m")).distinct()
    words = lambda x: F.size(F.split(x, " "))
    near = along.filter((F.col("m") != "") & (words(F.col("m")) == words(F.col("k")))).withColumn("distance", F.levenshtein("k", "m"))
    near = near.filter(F.col("distance").between(1, most)).join(alike, "display", "left_anti").join(used, "m", "left_anti")
    best = F.min(F.struct("distance", (-F.col("share")).alias("s"), "name")).alias("b")
    return near.groupBy("display").agg(best).select("display", "b.name", (-F.col("b.s")).alias("share"), "b.distance")


def name_votes(points: DataFrame, point: str, name: str) -> DataFrame:
    """name, points: at how many points each name was found; once a point, nulls left out."""
    return points.filter(F.col(name).isNotNull()).select(point, name).distinct().groupBy(name).agg(F.count(F.lit(1)).alias("points"))


def select_ids(entries: DataFrame, only: str = "", rivers: str = "") -> DataFrame:
    """Rows of ``entries`` (id, river, place) that a request names; all where it is empty.

    ``only`` lists identifiers and ranges "a..b" inside one river, ``rivers`` whole rivers.
    What the request names and the table lacks, ranges over two rivers and reversed ones
    raise ValueError.  The driver sees the rows of the named identifiers alone.
    """
    items = [x.strip() for x in only.split(",") if x.strip()]
    wanted = [x.strip() for x in rivers.split(",") if x.strip()]
    if not items and not wanted:
        return entries
    spans = [tuple(x.split("..", 1)) if ".." in x.strip(".") else (x, x) for x in items]
    named = {r.id: (r.river, r.place) for r in entries.filter(F.col("id").isin(sorted({x for s in spans for x in s}))).select("id", "river", "place").collect()}
    if lacking := sorted({x for s in spans for x in s} - named.keys()):
        raise ValueError(f"unknown identifiers: {', '.join(lacking)}")
    known = {r.river for r in entries.filter(F.col("river").isin(wanted)).select("river").distinct().collect()}
    if lacking := [x for x in wanted if x not in known]:
        raise ValueError(f"unknown rivers: {', '.join(lacking)}")
    keep = F.col("river").isin(wanted)
    for a, b in spans:
        (river, low), (other, high) = named[a], named[b]
        if river != other:
            raise ValueError(f"range {a}..{b} mixes rivers")
        if low > high:
            raise ValueError(f"range {a}..{b} is reversed")
        keep = keep | ((F.col("id") == a) if a == b else ((F.col("river") == river) & F.col("place").between(low, high)))
    return entries.filter(keep)


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """id, path: identifiers from the root down to each node, by pointer doubling.

    ``nodes`` has id and parent (null at the roots), as texts.  An unknown parent raises
    ValueError, a cycle ``graph.CycleError``.
    """
    plain = nodes.select("id", "parent")
    lost = plain.filter("parent IS NOT NULL").join(plain.select(F.col("id").alias("_p")).distinct(), F.col("parent") == F.col("_p"), "left_anti")
    if found := lost.limit(1).collect():
        raise ValueError(f"{found[0].id}: unknown node {found[0].parent}")
    # No text is the end's number once it has a slash before it.
    marked = lambda c: F.concat(F.lit("/"), c)
    links = plain.select(marked("id").alias("id"), marked("parent").alias("next"), F.col("id").alias("own"))
    paths = climb(links, {"path": F.array("own")}, {"path": lambda below, above: F.concat(above, below)})
    return paths.select(F.substring("id", 2, 1 << 30).alias("id"), "path")


def depth_first(nodes: DataFrame) -> DataFrame:
    """``nodes`` in depth-first order, children by the code points of their identifiers, with depth."""
    paths = cut(ancestor_paths(nodes))
    return nodes.join(paths.select("id", "path"), "id").withColumn("depth", F.size("path") - 1).orderBy("path").drop("path")


def hierarchy_problems(nodes: DataFrame) -> DataFrame:
    """id, problem of nodes (id, parent, level, place): identifiers used twice, wrong levels, parents that are not listed before."""
    twice = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    roots = nodes.filter("parent IS NULL AND level <> 0").select("id", F.lit("root must be level 0").alias("problem"))
    above = nodes.groupBy(F.col("id").alias("_id")).agg(F.min_by(F.struct("place", "level"), "place").alias("_above"))
    below = nodes.filter("parent IS NOT NULL").join(above, F.col("parent") == F.col("_id"), "left")
    late = F.col("_above").isNull() | (F.col("_above.place") >= F.col("place"))
    problem = F.when(late, "parent not listed before it").when(F.col("level") != F.col("_above.level") + 1, "level is not one below its parent")
    return twice.unionByName(roots).unionByName(below.select("id", problem.alias("problem")).filter("problem IS NOT NULL"))
