"""Corpus pipeline: documents to a mixed training set, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and
returns the rows that go on; all but the last keep the columns of ``documents``.  A stage
is written as Parquet in the cluster's shared folder and read again for the next one.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns of any name.  A null text counts as empty: the model judges it,
one of all empty texts stays, it is near nothing and holds no benchmark window.  Rows with
a null doc_id are judged by their text and stay behind those that have one.  Of rows that
repeat doc_id and text one stays.  An empty table gives no rows; without labels the model is
fitted on nothing, and without a benchmark all rows are clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluvius.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from fluvius.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores below its threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.75 the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks, with copy_no."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: The model, the similarity join and the suffix arrays have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
