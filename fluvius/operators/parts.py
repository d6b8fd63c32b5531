"""Connected parts of a network: edges labelled with their part, and parts small enough solved many at once in a task.

Most networks fall into many parts.  Such a part needs no rounds over the whole table: its
edges are brought together by one shuffle and numpy solves the parts of a batch side by side.
Parts beyond a given size are left to rounds on Spark, so no task holds one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import components
from .iterate import settle

#: Rows that a task takes up at once, and the last of these whose parts may go on in what follows.
BATCH, TAIL = 200_000, 4096


def numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """All values in order, and the columns as places among them."""
    whole = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]).dictionary_encode()
    order = pc.sort_indices(whole.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[whole.indices.to_numpy(zero_copy_only=False)]
    return whole.dictionary.take(pa.array(order)), np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers below n that each is linked with by the pairs (a, b), directly or by others."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return low
        least = np.minimum(x, y)
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        while not (low == (further := low[low])).all():
            low = further


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to BATCH rows and more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the part that they form in a batch.

    Parts of the last edges of a batch are held back for the next one, unless they are half of
    it: where the edges of a part lie together, the end of a batch does not cut it.
    """
    rest = None
    for t in _in_batches(batches):
        t = pa.concat_tables([rest, t]) if rest else t
        names, (a, b) = numbered(t["src"], t["dst"])
        low = _lowest(a, b, len(names))[a]
        open_ = np.isin(low, low[-TAIL:])
        if open_.mean() > 0.5:
            open_[:] = False
        rest = t.filter(pa.array(open_))
        yield from t.append_column("part", names.take(pa.array(low))).filter(pa.array(~open_)).to_batches()
    if rest:
        names, (a, b) = numbered(rest["src"], rest["dst"])
        yield from rest.append_column("part", names.take(pa.array(_lowest(a, b, len(names))[a]))).to_batches()


def in_parts(edges: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges`` (src, dst, ...) with the part they belong to, and (id, part, mark) of all their ends; edges with a null end go.

    ``marks`` (id, mark int) are put together by the bits of ``mark`` (0 where there is none);
    marked ids that no edge meets have no part.  Each batch of a task labels its own edges
    first, so only labels that meet at an id go on to rounds over all; where the edges of a
    part lie together, none do.
    """
    kind = edges.schema["src"].dataType
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL").withColumn("dst", F.col("dst").cast(kind))
    rows = settle(rows.mapInArrow(_label, StructType([*rows.schema.fields]).add("part", kind)))
    ends = rows.select(F.inline(F.array(F.struct(F.col("src").alias("id"), "part"), F.struct(F.col("dst").alias("id"), "part"))))
    every = ends.withColumn("mark", F.lit(0))
    if marks is not None:
        every = every.unionByName(marks.select(F.col("id").cast(kind).alias("id"), F.lit(None).cast(kind).alias("part"), "mark"))
    held = settle(every.groupBy("id").agg(F.min("part").alias("part"), F.max("part").alias("most"), F.bit_or("mark").alias("mark")))
    shared = held.filter("part <> most").select("id", F.col("part").alias("b"))
    if not shared.isEmpty():
        one = settle(components(ends.join(shared, "id").filter("part <> b").select(F.col("part").alias("a"), "b").distinct()))
        join = lambda of: of.join(one.select(F.col("id").alias("_p"), "component"), F.col("part") == F.col("_p"), "left").withColumn("part", F.coalesce("component", "part")).drop("_p", "component")
        rows, held = settle(join(rows)), settle(join(held))
    return rows, held.select("id", "part", "mark")


def split(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``rows`` (part, ...) of parts with at most ``most`` of them, those of larger ones, and these (part); None where there are none."""
    large = settle(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("part"))
    if large.isEmpty():
        return rows, rows.filter("false"), None
    return rows.join(large, "part", "left_anti"), rows.join(large, "part", "left_semi"), large


def solve(rows: DataFrame, kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """What ``kernel`` makes of ``rows`` (part, ...), given some whole parts at once and the number of the part of each row."""

    def work(batches):
        rest = None
        for t in _in_batches(batches):
            t = pa.concat_tables([rest, t]) if rest else t
            first = pc.index(t["part"], t["part"][-1]).as_py()
            rest = t.slice(first)
            if first:
                yield from run(t.slice(0, first))
        if rest:
            yield from run(rest)

    def run(t):
        code = numbered(t["part"])[1][0]
        return kernel(t, code).cast(wanted).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(work, schema)


class Outward:
    """Edges by their source: those that leave a set of nodes, by number."""

    def __init__(self, src: np.ndarray, n: int):
        self.order = np.argsort(src, kind="stable")
        self.first = np.searchsorted(src[self.order], np.arange(n + 1))

    def of(self, nodes: np.ndarray) -> np.ndarray:
        count = self.first[nodes + 1] - self.first[nodes]
        ahead = np.repeat(self.first[nodes] - (np.cumsum(count) - count), count)
        return self.order[ahead + np.arange(len(ahead))]
