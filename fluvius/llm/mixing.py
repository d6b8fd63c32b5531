"""Mixing sources to target weights.

Words are summed per source, target sizes follow from the weights with a ceiling of
``max_rate`` times the source's size (the excess goes to the others by weight), and
a document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with
probability equal to the rate's fraction.  A source's seed is the one of a fixed list
whose copies come nearest its target, found in the same pass that sums all seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

SEEDS = 16
MAX_RATE = 3.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) from the seed and the identifier."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_rate: float = MAX_RATE) -> DataFrame:
    """source, source_size -> also weight, target.

    Sources by code point, null last, take the weights in turn.  Sorted by ceiling per
    weight, the sources at their ceiling are the first ones, so one pass of running
    sums finds the level that the fixed point of capping and resharing reaches.
    The table has a row per source, not per document.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(max_rate))
    rows = rows.withColumn("at", F.col("most") / F.col("weight"))
    order = everything.orderBy("at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("level") > F.col("at"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def _sized(docs: DataFrame, source_col: str, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))


def _plan(sized: DataFrame, scratch: Scratch, weights, max_rate: float) -> DataFrame:
    """p_source, source_size, target, whole, part, seed: a row per source, written."""
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    plan = scratch.cut(plan.withColumnRenamed("source", "p_source"), "rates")
    # The source table is broadcast by Spark where its size allows and shuffled otherwise.
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    drawn = [F.sum(F.when(chance(s, F.col("doc_id")) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    want = F.col("target") - F.col("whole") * F.col("source_size")
    sums = joined.groupBy("source", "whole", "source_size", "target").agg(*drawn)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - want).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]))["seed"]
    seeds = sums.select(F.col("source").alias("q_source"), best.alias("seed"))
    return scratch.cut(plan.join(seeds, F.col("p_source").eqNullSafe(F.col("q_source"))).drop("q_source"), "plan")


def _copies(doc_id: Column) -> Column:
    """Copies of a row that is joined with its source's plan."""
    pick = F.lit(False)
    for s in range(SEEDS):
        pick = F.when(F.col("seed") == s, chance(s, doc_id) < F.col("part")).otherwise(pick)
    return (F.col("whole") + F.when(pick, 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, weights=(1.0, 2.0, 3.0), max_rate: float = MAX_RATE, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.cut(_sized(docs, source_col, text_col, id_col), "sized")
    plan = _plan(sized, scratch, weights, max_rate)
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), max_rate: float = MAX_RATE) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as the mix takes it, with copy_no from 0.

    A null source is a source of its own, last in order; a null text has no words and
    stays as often as its source's rate says; rows that repeat a doc_id draw alike.  A
    source without words has rate 0.  Texts are not shuffled: the plan has a row per source.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.cut(_sized(docs, "source", "text", "doc_id"), "sized")
    plan = _plan(sized, scratch, weights, max_rate).select(*[F.col(c).alias(f"mix_{c}") for c in ("p_source", "whole", "part", "seed")])
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("mix_row")
    rows = docs.select(own).join(plan, F.col("mix_row.source").eqNullSafe(F.col("mix_p_source")))
    rows = rows.select("mix_row", F.col("mix_whole").alias("whole"), F.col("mix_part").alias("part"), F.col("mix_seed").alias("seed"))
    rows = rows.withColumn("copies", _copies(F.col("mix_row.doc_id"))).filter(F.col("copies") > 0)
    return rows.select("mix_row", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("mix_copy")).select("mix_row.*", F.col("mix_copy").alias("copy_no"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _chance_sql(seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0"


SQL = (
    r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM s),
o AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
f AS (SELECT *, lvl > most / weight AS is_full FROM o),
t AS (SELECT *, CASE WHEN is_full THEN most ELSE weight * (max(CASE WHEN NOT is_full THEN lvl END) OVER ()) END AS target FROM f),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
   CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part FROM t),
j AS (SELECT sized.doc_id, sized.size, r.* FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source),
c AS ("""
    + "\n UNION ALL ".join(f"SELECT doc_id, source, size, source_size, target, whole, {s} AS seed, CASE WHEN {_chance_sql(s)} < part THEN 1 ELSE 0 END AS extra FROM j" for s in range(SEEDS))
    + r"""),
b AS (SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(extra * size) - (target - whole * source_size)), seed) AS rn
  FROM c GROUP BY source, seed, target, whole, source_size)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * (c.whole + c.extra) AS BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.seed = b.seed AND b.rn = 1
"""
)
