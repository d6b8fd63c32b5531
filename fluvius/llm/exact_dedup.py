"""Exact dedup over a log-structured merge index of text digests.

A memtable is one task's share of a batch: it leaves as a run of (digest, doc_id)
sorted by digest, with fence statistics and a Parquet Bloom filter on the digest.
Compaction merges runs into one level that keeps, for each digest, the smallest
identifier and the count.  A hit (a row whose digest is held by a smaller
identifier) is believed only after its bytes equal the keeper's bytes; what does
not verify is grouped by its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, collapsed, settings, table

#: Copies compared with one replica of the keeper's text; larger groups get more replicas.
COPIES_PER_REPLICA = 256
#: Batches in which a whole table is indexed: each is flushed as runs and merged with the level so far.
BATCHES = 2
FILTERED = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "200000"}


class DigestIndex:
    """Runs and one compacted level, as tables in the shared folder.

    ``key_bytes`` shortens the digest under which rows are indexed (tests use it to
    force collisions); results do not depend on it.
    """

    def __init__(self, spark: SparkSession, key_bytes: int = 32):
        self.spark, self.key_bytes = spark, key_bytes
        self.scratch = Scratch(spark, "digest-index")
        self.runs: list[str] = []
        self.level: str | None = None
        self.merged: set[str] = set()

    def flush(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Write a batch's sorted runs, without a shuffle; a batch flushed again replaces its runs."""
        sha = F.unhex(F.sha2(F.encode(collapsed(F.col(text_col)), "UTF-8"), 256))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("name"), sha.alias("sha"))
        rows = rows.select("doc_id", "name", "sha", F.substring("sha", 1, self.key_bytes).alias("key"))
        run = self.scratch.cut(rows.sortWithinPartitions("key", "doc_id"), f"run-{batch}", **FILTERED)
        if f"run-{batch}" not in self.runs:
            self.runs.append(f"run-{batch}")
        return run

    def entries(self) -> DataFrame:
        parts = [self.scratch.read(r) for r in self.runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self) -> DataFrame:
        """Merge the runs not merged yet with the level; smallest identifiers stay."""
        fresh = [r for r in self.runs if r not in self.merged]
        rows = None
        for r in fresh:
            part = self.scratch.read(r).select("key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
            rows = part if rows is None else rows.unionByName(part)
        if self.level:
            old = self.scratch.read(self.level)
            rows = old if rows is None else rows.unionByName(old)
        name = f"level-{len(self.runs)}-{len(self.merged)}"
        merged = rows.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        out = self.scratch.cut(merged.sortWithinPartitions("key"), name, **FILTERED)
        if self.level and self.level != name:
            self.scratch.drop(self.level)
        self.level, self.merged = name, set(self.runs)
        return out

    def lookup(self, keys: list[bytes]) -> DataFrame:
        """Point lookups: fences and Bloom filters skip row groups that cannot hold a key."""
        return self.scratch.read(self.level).filter(F.col("key").isin([bytearray(k) for k in keys]))


def resolve(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, sha for every indexed row, after byte verification of the hits."""
    spark, scratch = index.spark, index.scratch
    level = scratch.read(index.level)
    joined = index.entries().join(level, "key")
    members = scratch.cut(joined.select("doc_id", "name", "sha", "key", "keep_id", "n"), "members")
    # Rows are known by a hash of identifier and text, so a null identifier is no exception; those that share it are compared by their digests.
    groups = members.filter(F.col("n") >= 2).select(F.col("doc_id").alias("m_id"), F.col("name").alias("m_name"), F.col("sha").alias("m_sha"), "key", "keep_id", "n").dropDuplicates(["m_name", "m_sha"])
    groups = scratch.cut(groups.withColumn("in_group", F.lit(1)), "groups").filter(F.col("in_group") == 1).drop("in_group")
    texts = docs.select(F.xxhash64(id_col, text_col).alias("t_name"), collapsed(F.col(text_col)).alias("t"))
    # Only members of groups move: Spark builds a Bloom filter of their identifiers while that fits.
    with settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0", spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="256m"):
        whole = texts.join(groups, F.col("t_name") == F.col("m_name"))
        whole = whole.filter(F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)) == F.col("m_sha")).drop("t_name")
        replicas = F.greatest(F.ceil(F.col("n") / COPIES_PER_REPLICA).cast("int"), F.lit(1))
        part = F.pmod(F.col("m_name"), replicas).cast("int")
        keepers = whole.filter(F.col("m_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["key"])
        keepers = keepers.select(F.col("key").alias("k_key"), F.col("t").alias("k_t"), F.explode(F.sequence(F.lit(0), replicas - 1)).alias("k_part"))
        copies = whole.filter(~F.col("m_id").eqNullSafe(F.col("keep_id"))).withColumn("part", part)
        checked = copies.join(keepers, (F.col("key") == F.col("k_key")) & (F.col("part") == F.col("k_part")), "left")
        strays = checked.filter(~F.coalesce(F.encode("t", "UTF-8") == F.encode("k_t", "UTF-8"), F.lit(False)))
        strays = scratch.cut(strays.select("key").distinct(), "strays")
    if strays.isEmpty():
        return members.select("doc_id", "keep_id", F.col("n").alias("group_size"), "sha")
    # Digests collided: in those groups the bytes themselves are the key.
    open_groups = groups.join(strays, "key", "left_semi")
    apart = texts.join(open_groups, F.col("t_name") == F.col("m_name")).filter(F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)) == F.col("m_sha"))
    apart = scratch.cut(apart.select("m_id", "m_name", "m_sha", F.col("key").alias("a_key"), "t"), "apart")
    by_text = apart.groupBy("a_key", "t").agg(F.min("m_id").alias("a_keep"), F.count(F.lit(1)).alias("a_n"))
    fixed = apart.join(by_text, ["a_key", "t"]).select("m_name", "m_sha", "a_keep", "a_n").dropDuplicates(["m_name", "m_sha"])
    out = members.join(fixed, (F.col("name") == F.col("m_name")) & (F.col("sha") == F.col("m_sha")), "left")
    fixed_one = F.col("m_name").isNotNull()
    return out.select("doc_id", F.when(fixed_one, F.col("a_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("a_n", "n").alias("group_size"), "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one
    space; a null text is empty.  Rows that repeat a doc_id and text count in
    group_size, and each of them carries the same decision.  A null doc_id is never a
    keeper of a group that has another id; a group of nulls only has keep_id null and
    is kept.  An empty table gives no rows.  Other columns are not looked at.
    """
    index = DigestIndex(docs.sparkSession, key_bytes)
    share = F.pmod(F.xxhash64(id_col), F.lit(BATCHES))
    for k in range(BATCHES):
        index.flush(docs.filter(share == k), str(k), id_col, text_col)
        index.compact()
    rows = resolve(index, docs, id_col, text_col)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, one for each text; of rows that repeat doc_id and text, one.

    All columns stay as they are.  Rows are told apart by doc_id and text, so a null
    doc_id does no harm.
    """
    scratch = Scratch(docs.sparkSession, "keep-first")
    name = lambda doc_id, sha: F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), sha)
    found = scratch.cut(exact_dedup(docs).select(name(F.col("doc_id"), F.col("text_sha256")).alias("gone_key"), "kept"), "decisions")
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own_row")
    rows = docs.select(own, name(F.col("doc_id"), F.sha2(F.encode(collapsed(F.col("text")), "UTF-8"), 256)).alias("own_key"))
    rows = rows.join(found.filter(~F.col("kept")).select("gone_key").distinct(), F.col("own_key") == F.col("gone_key"), "left_anti")
    if not found.filter("kept").groupBy("gone_key").count().filter(F.col("count") > 1).isEmpty():
        rows = rows.dropDuplicates(["own_key"])
    return rows.select("own_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
