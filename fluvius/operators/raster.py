"""Raster operators on pixel tables (row, col, band values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components


def ratio(a: Column, b: Column) -> Column:
    """Normalised difference over absolute values; null where both are zero."""
    return (a - b) / F.nullif(F.abs(a) + F.abs(b), F.lit(0.0))


def frequency(looks: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, looks, freq: share of valid looks that are wet; null below ``least`` looks."""
    n, wet = F.count_if("valid"), F.count_if(F.col("valid") & F.col("wet"))
    return looks.groupBy(*keys).agg(n.alias("looks"), F.when(n >= least, wet / n).alias("freq"))


def dilate(pixels: DataFrame, steps: int = 1) -> DataFrame:
    """(row, col) set grown by ``steps`` to the four neighbours."""
    for _ in range(steps):
        moves = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
        pixels = pixels.select(F.inline(moves)).distinct()
    return pixels


def erode(pixels: DataFrame, steps: int = 1) -> DataFrame:
    """(row, col) set of pixels whose four neighbours are all set."""
    for _ in range(steps):
        moves = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
        pixels = pixels.select(F.inline(moves)).groupBy("row", "col").agg(F.count("*").alias("n")).filter("n = 5").select("row", "col")
    return pixels


def closing(pixels: DataFrame, steps: int = 1) -> DataFrame:
    return erode(dilate(pixels, steps), steps)


def opening(pixels: DataFrame, steps: int = 1) -> DataFrame:
    return dilate(erode(pixels, steps), steps)


def zones(pixels: DataFrame, width: int) -> DataFrame:
    """row, col, zone: connected sets (four neighbours), named by their least row * width + col."""
    ids = pixels.select((F.col("row") * width + F.col("col")).cast("long").alias("id"), "row", "col")
    right = ids.join(pixels.select("row", (F.col("col") - 1).alias("col")), ["row", "col"]).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    down = ids.join(pixels.select((F.col("row") - 1).alias("row"), "col"), ["row", "col"]).select(F.col("id").alias("a"), (F.col("id") + width).alias("b"))
    found = components(right.unionByName(down), ids)
    return ids.join(found, "id").select("row", "col", F.col("component").alias("zone"))


def holes(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(row, col) of unset pixels that no unset path joins with the edge of the frame."""
    spark = pixels.sparkSession
    frame = spark.range(height * width).select(F.floor(F.col("id") / width).cast("long").alias("row"), (F.col("id") % width).alias("col"))
    empty = zones(frame.join(pixels, ["row", "col"], "left_anti"), width)
    open_ = empty.filter((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)).select("zone").distinct()
    return empty.join(open_, "zone", "left_anti").select("row", "col")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, iou: pixels in both over pixels in either."""
    both = a.select("row", "col").join(b.select("row", "col"), ["row", "col"]).agg(F.count("*").alias("x"))
    return a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b"))).crossJoin(both).select((F.col("x") / F.nullif(F.col("a") + F.col("b") - F.col("x"), F.lit(0))).alias("iou"))
