"""Match tiers: the best candidate of a key, its margin over the second, and a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(candidates: DataFrame, key: str, name: str, share: str, high: float, medium: tuple[float, float], low: float) -> DataFrame:
    """key, name, share, tier, margin.  Ties go to the lowest name; the two best come from one grouped pass."""
    top = F.array_sort(F.collect_set(F.struct((-F.col(share)).alias("s"), F.col(name).alias("n"))))
    best = candidates.groupBy(key).agg(F.slice(top, 1, 2).alias("t"))
    s1, s2 = -F.get("t", F.lit(0))["s"], F.coalesce(-F.get("t", F.lit(1))["s"], F.lit(0.0))
    tier = F.when(s1 >= high, "high").when((s1 >= medium[0]) & (s1 - s2 >= medium[1]), "medium").when(s1 >= low, "low").otherwise("none")
    return best.select(key, F.get("t", F.lit(0))["n"].alias(name), s1.alias(share), tier.alias("tier"), F.round(s1 - s2, 9).alias("margin"))


def vote(counts: DataFrame, total: str, first: str, second: str, least: float, labels: tuple[str, str]) -> DataFrame:
    """``counts`` with vote: the label with at least ``least`` of all points, the first one on a tie, else null."""
    a, b, n = F.col(first), F.col(second), F.col(total)
    share = lambda x: (n > 0) & (x >= least * n)
    return counts.withColumn("vote", F.when(share(a) & (a >= b), labels[0]).when(share(b), labels[1]))
