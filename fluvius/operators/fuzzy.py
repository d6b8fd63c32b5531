"""Pairs of similar names without comparing all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_names(names: DataFrame, least: float = 0.7) -> DataFrame:
    """a, b, s: pairs a < b of different ``names`` (column name) with an edit similarity of ``least`` or more.

    With k edits in a longer name of length n, a shorter one cut into k + 1 pieces has a
    piece that stands unchanged in the longer one, at most k places off.  So the shorter
    name is listed by its pieces for each n that it can be matched with, the longer one
    looks up its substrings, and what shares a piece is compared.  Nothing is lost at any
    length, and a pair is made only where a piece is shared.  Null names pair with nothing.
    """
    lib = names.select(F.col("name").cast("string").alias("name")).dropna().distinct().withColumn("len", F.length("name")).filter("len > 0")
    edits = lambda n: F.floor(n * (1 - least) + 1e-9).cast("int")
    start = lambda size, k, i: F.floor(size * i / (k + 1)).cast("int")
    n, m, k, i = (F.col(x) for x in ("n", "m", "k", "i"))
    longest = F.floor(F.col("len") / least + 1e-9).cast("int")
    short = lib.select("name", F.col("len").alias("m"), F.explode(F.sequence(F.col("len"), longest)).alias("n")).withColumn("k", edits(n)).filter((n - m) <= k)
    short = short.select("name", "m", "k", F.explode(F.sequence(F.lit(0), k)).alias("i")).distinct()
    at = start(m, k, i)
    pieces = short.select(F.col("name").alias("a"), "m", "k", "i", F.substring("name", at + 1, start(m, k, i + 1) - at).alias("piece"))
    long = lib.select("name", F.col("len").alias("n"), edits(F.col("len")).alias("k"))
    long = long.select("name", "n", "k", F.explode(F.sequence(n - k, n)).alias("m")).select("*", F.explode(F.sequence(F.lit(0), k)).alias("i"))
    size = start(m, k, i + 1) - start(m, k, i)
    lo, hi = F.greatest(start(m, k, i) - k, F.lit(0)), F.least(start(m, k, i) + k, n - size)
    long = long.filter(lo <= hi).select("name", "m", "k", "i", size.alias("size"), F.explode(F.sequence(lo, hi)).alias("at"))
    looks = long.select(F.col("name").alias("b"), "m", "k", "i", F.substring("name", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    # Few bytes make many pairs: the number of tasks is named, as Spark would put small tables together into one.
    tasks, key = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["m", "k", "i", "piece"]
    both = pieces.repartition(tasks, *key).join(looks.repartition(tasks, *key).hint("merge"), key).filter("a <> b")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition(tasks, "a", "b").distinct()
    # Distances are worked out only as far as they may go; beyond that they are -1.
    most = F.greatest(F.length("a"), F.length("b"))
    near = both.withColumn("d", F.expr(f"levenshtein(a, b, int(floor(greatest(length(a), length(b)) * (1 - {least}D) + 1e-9)))")).filter("d >= 0")
    return near.select("a", "b", (1 - F.col("d") / most).alias("s")).filter(F.col("s") >= least)
