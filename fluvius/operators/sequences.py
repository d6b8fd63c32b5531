"""Operators along sequences: runs, smoothing, running median, exceedance, intervals, deltas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, run_from, run_to, value: maximal runs of equal values (null equals null) as half-open ordinals."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_new", ((F.col("_n") == 0) | ~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_run").agg(F.min("_n").cast("long").alias("run_from"), (F.max("_n") + 1).cast("long").alias("run_to"), F.first(value).alias(value)).drop("_run")


def smooth(values: list, step: float, shortest: float) -> list[tuple[int, int, object]]:
    """Runs of one sequence, smoothed pass by pass until none changes anything.

    A pass judges the runs as it finds them: one shorter than ``shortest`` between two runs
    of one value, which is not null, takes that value.
    """
    now = [None if pd.isna(v) else v for v in values]
    while True:
        edges = [0, *(i for i in range(1, len(now)) if now[i] != now[i - 1]), len(now)]
        found = [(a, b, now[a]) for a, b in zip(edges, edges[1:]) if a < b]
        short = [(b, a[2]) for a, b, c in zip(found, found[1:], found[2:]) if a[2] is not None and a[2] == c[2] and (b[1] - b[0]) * step < shortest]
        if not short:
            return found
        for (a, b, _), v in short:
            now[a:b] = [v] * (b - a)


def runs_smoothed(df: DataFrame, key: str, order: list[str], value: str, step: float, shortest: float) -> DataFrame:
    """key, run_from, run_to, value after smoothing; a sequence is one group of an Arrow function."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = [(pdf[key].iloc[0], a, b, v) for a, b, v in smooth(pdf[value].tolist(), step, shortest)]
        return pd.DataFrame(rows, columns=[key, "run_from", "run_to", value])

    kinds = dict(df.dtypes)
    return df.select(key, *order, value).groupBy(key).applyInPandas(work, f"{key} {kinds[key]}, run_from long, run_to long, {value} {kinds[value]}")


def running_median(df: DataFrame, key: str, order: list[str], value: str, half: int, label: str) -> DataFrame:
    """``df`` with median: of values within ``half`` rows that carry the same label; a null value stays null."""
    near = F.collect_list(F.struct(F.col(label).alias("l"), F.col(value).alias("v"))).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half))
    same = F.array_sort(F.transform(F.filter(near, lambda x: x["l"].eqNullSafe(F.col(label)) & x["v"].isNotNull()), lambda x: x["v"]))
    n = F.size(same)
    lo, hi = F.get(same, F.floor((n - 1) / 2).cast("int")), F.get(same, F.floor(n / 2).cast("int"))
    return df.withColumn("median", F.when(F.col(value).isNotNull(), (lo + hi) / 2))


def exceedance(df: DataFrame, key: str, order: list[str], at: str, value: str, limit: float) -> DataFrame:
    """key, length, peak: how much of ``at`` lies over ``limit`` with straight lines between rows, and the largest value."""
    w = Window.partitionBy(key).orderBy(*order)
    v1, x1 = F.lag(value).over(w), F.lag(at).over(w)
    rows = df.select(key, F.col(at).alias("_x"), F.col(value).alias("_v"), v1.alias("_v1"), x1.alias("_x1"))
    a, b = F.col("_v1") - limit, F.col("_v") - limit
    part = F.when((a > 0) & (b > 0), 1.0).when((a <= 0) & (b <= 0), 0.0).when(a > 0, a / (a - b)).otherwise(b / (b - a))
    return rows.groupBy(key).agg(F.coalesce(F.sum((F.col("_x") - F.col("_x1")) * part), F.lit(0.0)).alias("length"), F.max("_v").alias("peak"))


def interval_union(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """key, lo, hi: merged intervals."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_g")


def deltas(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``df`` with delta: the first value, then differences."""
    before = F.lag(value, 1).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("delta", F.col(value) - F.coalesce(before, F.lit(0)))


def undelta(df: DataFrame, key: str, order: list[str], delta: str = "delta") -> DataFrame:
    """``df`` with restored: running sums of the deltas."""
    return df.withColumn("restored", F.sum(delta).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def interpolate(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``df`` with filled: nulls between two values on the straight line of ``order``, at the ends the nearest value."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("v")))
    a, b = F.last(mark, True).over(back), F.first(mark, True).over(ahead)
    line = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0).cast("double"))
    return df.withColumn("filled", F.coalesce(value, line, a["v"], b["v"]))


def evenly_spaced(items: Column, n: int) -> Column:
    """n items of an array, both ends kept; all of them where there are no more than n."""
    size = F.size(items)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(items, F.floor(i * (size - 1) / (n - 1) + 0.5).cast("int")))
    return F.when(size <= n, items).otherwise(picks)


def cut_windows(length: Column, size: float) -> Column:
    """Equal windows of about ``size``: array of (n, from, to, prev, next), lengths summing exactly."""
    n = F.greatest(F.round(length / size), F.lit(1)).cast("int")
    at = lambda i: length * i / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("n"), at(i).alias("from"), at(i + 1).alias("to"), F.when(i > 0, i - 1).alias("prev"), F.when(i < n - 1, i + 1).alias("next")))
