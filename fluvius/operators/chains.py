"""Walks along single successors by pointer doubling: chains, cycles, and lines merged from segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import plain_plans, settle


def chase(rows: DataFrame) -> DataFrame:
    """(id, nxt) -> (id, end, steps, low, far): where the walk ends, in how many steps, the least id on it, and in how many steps that is met.

    Each id has one successor at most and is the successor of one at most; ``nxt`` is null
    at an end.  On a cycle ``end`` is null and ``low`` is the cycle's least id.  A round
    doubles what every walk has seen and writes it as a table, so log2 of the longest walk
    rounds suffice.  Cycles are known to be whole when no open walk's least id differs from
    that of the place it has got to: on a path, and on a cycle not yet gone round, some do.
    """
    with plain_plans(rows.sparkSession):
        now = rows.select("id", "nxt", F.col("id").alias("low"), F.when(F.col("nxt").isNull(), F.col("id")).alias("end"), F.lit(0).cast("long").alias("steps"), F.lit(1).cast("long").alias("jump"), F.lit(0).cast("long").alias("far"))
        now = settle(now.withColumn("open", F.col("end").isNull()))
        while not now.filter("open").isEmpty():
            ahead = now.select(F.col("id").alias("a_id"), F.col("nxt").alias("a_nxt"), F.col("low").alias("a_low"), F.col("end").alias("a_end"), F.col("steps").alias("a_steps"), F.col("jump").alias("a_jump"), F.col("far").alias("a_far"))
            done = F.col("end").isNotNull()
            now = settle(
                now.join(ahead, F.col("nxt") == F.col("a_id"), "left").select(
                    "id",
                    F.when(~done, F.col("a_nxt")).alias("nxt"),
                    F.when(done, F.col("low")).otherwise(F.least("low", "a_low")).alias("low"),
                    F.when(done, F.col("end")).otherwise(F.col("a_end")).alias("end"),
                    F.when(done, F.col("steps")).when(F.col("a_end").isNotNull(), F.col("jump") + F.col("a_steps")).otherwise(F.lit(0)).alias("steps"),
                    F.when(done, F.col("jump")).otherwise(F.col("jump") + F.col("a_jump")).alias("jump"),
                    F.when(done | (F.col("low") <= F.col("a_low")), F.col("far")).otherwise(F.col("jump") + F.col("a_far")).alias("far"),
                    (~done & F.col("a_end").isNull() & (F.col("low") != F.col("a_low"))).alias("open"),
                )
            )
    return now.select("id", "end", "steps", "low", "far")


def cycle_order(rows: DataFrame) -> DataFrame:
    """(id, nxt) of cycles only -> (id, ring, seq): the cycle's least id, and the place on the cycle from it."""
    found = settle(chase(rows).select("id", F.col("low").alias("ring"), "far"))
    size = found.groupBy(F.col("ring").alias("z_ring")).agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, F.col("ring") == F.col("z_ring")).select("id", "ring", F.pmod(F.col("size") - F.col("far"), F.col("size")).alias("seq"))


def merge_lines(segments: DataFrame, a: str = "a", b: str = "b", id_col: str = "id") -> DataFrame:
    """Undirected segments -> (id, chain, seq, forward, closed): maximal lines through points that two segment ends share.

    ``chain`` is the least segment id of the line, ``seq`` the place on it from 0 and
    ``forward`` whether the segment runs from a to b along it.  An open line starts at the
    end whose segment has the smaller id (on a line of one segment, at its a); a closed one
    starts at its least segment, forward.  A segment from a point to itself is a closed line
    where nothing else ends there.  Ids must be distinct positive numbers; a null end joins
    nothing.
    """
    rows = segments.select(F.col(id_col).cast("long").alias("id"), F.col(a).alias("a"), F.col(b).alias("b"))
    # Halves: a segment walked from a to b has the number 2 id, from b to a 2 id + 1.
    halves = rows.select((F.col("id") * 2).alias("h"), F.col("a").alias("u"), F.col("b").alias("v")).unionByName(rows.select((F.col("id") * 2 + 1).alias("h"), F.col("b").alias("u"), F.col("a").alias("v")))
    halves = settle(halves)
    through = halves.filter("u is not null").groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.min("h").alias("h0"), F.max("h").alias("h1")).filter("d = 2").select(F.col("u").alias("at"), "h0", "h1")
    twin = F.col("h").bitwiseXOR(F.lit(1))
    nxt = F.when(F.col("h0") == twin, F.col("h1")).otherwise(F.col("h0"))
    walk = settle(halves.join(through, F.col("v") == F.col("at"), "left").select(F.col("h").alias("id"), F.when(F.col("at").isNotNull(), nxt).alias("nxt")))
    found = chase(walk)
    back = found.select(F.col("id").bitwiseXOR(F.lit(1)).alias("r_id"), F.col("end").bitwiseXOR(F.lit(1)).alias("start"), F.col("steps").alias("before"))
    both = settle(found.join(back, F.col("id") == F.col("r_id")).select("id", "start", "end", "before", "low"))
    # Of the two directions of an open line, that which starts at the smaller half.
    line = both.filter("end is not null and start < (end ^ 1)")
    least = F.min(F.shiftright("id", 1)).over(Window.partitionBy("start"))
    line = line.select(F.shiftright("id", 1).alias("id"), least.alias("chain"), F.col("before").alias("seq"), (F.col("id") % 2 == 0).alias("forward"), F.lit(False).alias("closed"))
    # Of the two directions of a closed one, that in which its least segment runs forward.
    loops = both.filter("end is null and low % 2 = 0").select(F.col("id").alias("k"))
    ring = cycle_order(walk.join(loops, F.col("id") == F.col("k"), "left_semi"))
    ring = ring.select(F.shiftright("id", 1).alias("id"), F.shiftright("ring", 1).alias("chain"), "seq", (F.col("id") % 2 == 0).alias("forward"), F.lit(True).alias("closed"))
    return line.unionByName(ring)
