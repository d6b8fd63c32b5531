"""Token counts: rollups by source, language and tokenizer version, kept up by deltas.

A batch of changes (insert, delete, revise) becomes signed rows: what a document counted
before is taken back, what it counts now is added.  The batch's signed rows are written
under its identifier, and its totals beside them; a batch is committed once both folders
are complete, and a batch that is committed is not applied again.  Totals are sums of the
committed deltas, so batches may come in any order of sources and be folded at any time.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

#: Words by ASCII white space, counted without a tokenizer file.
WORDS = "words-1"
BPE = "byte_bpe_50k"
BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary; a fixed value.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are handed to the tokenizer in parts of about this many characters, cut before white space.
PART = 1 << 16
SIGNED = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"

_loaded: dict[str, object] = {}


def encoding(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("counts", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def parts(text: str) -> list[str]:
    """The text in parts that the pattern splits alike: cut between a word character and a single space that a word follows."""
    out, a, n = [], 0, len(text)
    while n - a > PART:
        b = a + PART
        while b < n - 1 and not (text[b] == " " and text[b - 1].isalpha() and text[b + 1].isalpha()):
            b += 1
        if b >= n - 1:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def count_tokens(text: str | None, path: str = BPE_FILE) -> int:
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(p)) for p in parts(text or ""))


def _counter(path: str):
    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = pa.array([count_tokens(t, path) for t in texts], pa.int64())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], [*keep, "tokens"])

    return work


def counted(changes: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """op, doc_id, source, lang, tokenizer, tokens: what each changed document counts now."""
    rows = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    out = None
    for name, path in tokenizers.items():
        if path is None:
            part = rows.select("op", "doc_id", "source", "lang", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
        else:
            part = rows.mapInArrow(_counter(path), "op string, doc_id long, source string, lang string, tokens long")
        part = part.select("op", "doc_id", "source", "lang", F.lit(name).alias("tokenizer"), "tokens")
        out = part if out is None else out.unionByName(part)
    return out


class Rollup:
    """Additive totals in a shared folder.

    A null doc_id can be inserted, but no later change can find it.  A delete or revision
    of a document that is not there takes nothing back.  Rows that repeat a doc_id in one
    insert count each; a later delete takes all of them back.  A batch is one point in
    time: its deletes and revisions take back what earlier batches counted, and each of
    its inserts and revisions counts, whatever their order.  An op that is none of the
    three stops the batch.
    """

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "token-counts")
        if at:
            self.scratch.at = at

    def committed(self) -> list[str]:
        """Identifiers of batches whose signed rows and totals are both complete."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.scratch.path("totals"))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(self.scratch.path(f"totals/{n}/_SUCCESS")))
        return sorted(n for n in names if done(n))

    def signed(self) -> DataFrame | None:
        names = self.committed()
        return self.spark.read.schema(SIGNED).parquet(*[self.scratch.path(f"signed/{n}") for n in names]) if names else None

    def apply(self, batch: str, changes: DataFrame, tokenizers: dict[str, str | None]) -> bool:
        """Commit a batch of (op, doc_id, source, lang, text); False if it was committed before."""
        if batch in self.committed():
            return False
        known = F.col("op").isin("insert", "revise", "delete")
        changes = changes.withColumn("op", F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))))
        now = counted(changes.filter(F.col("op") != "delete"), tokenizers)
        rows = now.select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("long").alias("docs"), "tokens")
        before = self.signed()
        if before is not None:
            gone = changes.filter(F.col("op").isin("delete", "revise") & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            old = before.filter(F.col("tokenizer").isin(*tokenizers)).join(gone, "doc_id")
            old = old.groupBy("doc_id", "source", "lang", "tokenizer").agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens"))
            rows = rows.unionByName(old.filter((F.col("docs") != 0) | (F.col("tokens") != 0)))
        rows = self.scratch.cut(rows, f"signed/{batch}")
        self.scratch.cut(rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), f"totals/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups without documents are left out."""
        names = self.committed()
        form = SIGNED.replace("doc_id long, ", "")
        if not names:
            return self.spark.createDataFrame([], form)
        rows = self.spark.read.schema(form).parquet(*[self.scratch.path(f"totals/{n}") for n in names])
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter((F.col("docs") != 0) | (F.col("tokens") != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the whole table, reached by a history of changes.

    All documents are inserted, some with a first draft of their text; the batch is sent
    twice, as after a lost reply, and counts once.  Then some documents are deleted; at
    last the drafts are revised and what was deleted is inserted again.
    """
    docs = table(spark, sf_dir, "documents")
    share = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(20)))
    draft, recalled = F.coalesce(share == 0, F.lit(False)), F.coalesce(share == 1, F.lit(False))
    tokenizers, rollup = {WORDS: None, BPE: BPE_FILE}, Rollup(spark)
    first = docs.withColumn("op", F.lit("insert")).withColumn("text", F.when(draft, F.concat(F.lit("Draft. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    for _ in range(2):
        rollup.apply("load", first, tokenizers)
    rollup.apply("recall", docs.filter(recalled).withColumn("op", F.lit("delete")), tokenizers)
    rollup.apply("final", docs.filter(draft | recalled).withColumn("op", F.when(draft, "revise").otherwise("insert")), tokenizers)
    return rollup.totals()
