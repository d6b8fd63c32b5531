"""Benchmark decontamination by suffix arrays over the training text.

A shard is a run of documents of about SHARD_WORDS words.  Its suffix array orders
the suffixes of every stretch of words that the benchmark knows (a suffix with another
word inside the window cannot hold the window).  Every suffix of every benchmark item
narrows its range of the array word by word with binary searches: the depth it reaches
is its longest verbatim match, and the range at the window's depth has the locations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, table

WINDOW = 10
SHARD_WORDS = 1_000_000
#: Benchmark text per pass; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20

#: Bytes of a word: digits, letters in lower case, anything from 0x80; the rest separates.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``a`` in the order of their suffixes' first ``depth`` values, by prefix doubling."""
    n = len(a)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    h = 1
    order = np.argsort(rank, kind="stable")
    while h < depth and n:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if fresh[order[-1]] == n - 1:
            break
        rank, h = fresh, 2 * h
    return order


class Items:
    """Benchmark items as word numbers; their suffixes are the queries."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, seqs = [], []
        for item_id, text in rows:
            if w := words(text):
                self.ids.append(item_id)
                seqs.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        lengths = np.array([len(s) for s in seqs], np.int64)
        self.flat = np.array([x for s in seqs for x in s] + [0], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        self.item = np.repeat(np.arange(len(seqs)), lengths)
        self.at = np.arange(len(self.flat) - 1)
        self.end = starts[1:][self.item] if len(seqs) else np.zeros(0, np.int64)
        self.offset = self.at - starts[self.item] if len(seqs) else np.zeros(0, np.int64)
        self.window = np.minimum(lengths, window)[self.item] if len(seqs) else np.zeros(0, np.int64)
        self.least = int(self.window.min()) if len(seqs) else 1
        self.longest = int(lengths.max()) if len(seqs) else 1


def _bound(a, sa, lo, hi, depth, want, upper):
    """First place in sa[lo:hi] whose value at ``depth`` is over (upper) or at least ``want``; all queries at once."""
    lo, hi, n = lo.copy(), hi.copy(), len(a)
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        pos = sa[np.where(live, mid, 0)] + depth
        v = np.where(pos < n, a[np.minimum(pos, n - 1)], -1)
        right = live & ((v <= want) if upper else (v < want))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(live & ~right, mid, hi)


def search(a: np.ndarray, sa: np.ndarray, items: Items):
    """For every item suffix: its longest match, the range there, and the range at its window's depth (or an empty one)."""
    q = len(items.at)
    lo, hi = np.zeros(q, np.int64), np.full(q, len(sa), np.int64)
    length = np.zeros(q, np.int64)
    wlo, whi = np.zeros(q, np.int64), np.zeros(q, np.int64)
    live, depth = np.arange(q), 0
    while len(live) and len(sa):
        live = live[items.at[live] + depth < items.end[live]]
        want = items.flat[items.at[live] + depth]
        first = _bound(a, sa, lo[live], hi[live], depth, want, False)
        last = _bound(a, sa, first, hi[live], depth, want, True)
        ok = last > first
        live, first, last = live[ok], first[ok], last[ok]
        lo[live], hi[live] = first, last
        depth += 1
        length[live] = depth
        at = live[items.window[live] == depth]
        wlo[at], whi[at] = lo[at], hi[at]
    return length, lo, hi, wlo, whi


def ranges(items: Items, lo: np.ndarray, hi: np.ndarray):
    """Bounds and window of each range that some window has, once however many windows are equal, and the numbers of their items."""
    picks = np.flatnonzero(hi > lo)
    which, back = np.unique(np.stack([lo[picks], hi[picks], items.window[picks]], 1), axis=0, return_inverse=True)
    order = np.argsort(back.ravel(), kind="stable")
    owners = np.split(items.item[picks[order]], np.cumsum(np.bincount(back.ravel(), minlength=len(which)))[:-1]) if len(which) else []
    return which[:, 0], which[:, 1], which[:, 2], [np.unique(x) for x in owners]


class Shard:
    """The words of some documents, and the suffix array of the stretches that can match."""

    def __init__(self, texts: list[list[int]], items: Items):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        flat = np.zeros(int(self.starts[-1]), np.int64)
        for t, s in zip(texts, self.starts):
            flat[s : s + len(t)] = t
        edge = np.diff(np.concatenate(([0], (flat > 0).astype(np.int8), [0])))
        run_from, run_to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = run_to - run_from >= items.least
        run_from, run_to = run_from[long], run_to[long]
        size = run_to - run_from + 1
        shift = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.place = np.repeat(run_from - shift, size) + np.arange(int(size.sum()))
        self.a = np.append(flat, 0)[self.place] if len(self.place) else np.zeros(0, np.int64)
        order = suffix_array(self.a, items.longest)
        self.sa = order[self.a[order] > 0] if len(order) else order

    def where(self, lo, hi, picks):
        """Documents, word positions and queries of all places in the picked ranges."""
        n = hi[picks] - lo[picks]
        which = np.repeat(picks, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = self.place[self.sa[np.repeat(lo[picks], n) + inside]]
        doc = np.searchsorted(self.starts, place, side="right") - 1
        return doc, place, which


def _shards(batches, items: Items):
    get = items.vocabulary.get
    held, texts, n = [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            t = [get(w, 0) for w in words(row["text"])]
            held.append(row)
            texts.append(t)
            n += len(t)
            if n >= SHARD_WORDS:
                yield held, texts, Shard(texts, items)
                held, texts, n = [], [], 0
    if held:
        yield held, texts, Shard(texts, items)


def _merge(spans: np.ndarray) -> np.ndarray:
    """Half-open spans (n, 2) as disjoint sorted ones."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])], 1)


def _mark(block, last: bool, kind):
    def mark(batches):
        items = block.value
        for held, texts, shard in _shards(batches, items):
            _, _, _, lo, hi = search(shard.a, shard.sa, items)
            lo, hi, window, owners = ranges(items, lo, hi)
            doc, place, which = shard.where(lo, hi, np.arange(len(lo)))
            order = np.argsort(doc, kind="stable")
            doc, place, which = doc[order], place[order], which[order]
            cuts = np.searchsorted(doc, np.arange(len(held) + 1))
            out = [[], [], [], [], []]
            for k, row in enumerate(held):
                c = slice(cuts[k], cuts[k + 1])
                local = place[c] - shard.starts[k]
                spans = np.stack([local, local + window[which[c]]], 1)
                old = np.array(row["spans"], np.int64).reshape(-1, 2)
                spans = _merge(np.concatenate([old, spans]))
                found = sorted({items.ids[i] for r in np.unique(which[c]) for i in owners[r]} | set(row["item_ids"]))
                for col, v in zip(out, (row["doc_id"], None if last else row["text"], len(texts[k]), spans.ravel().tolist(), found)):
                    col.append(v)
            kinds = (kind, pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "text", "n_words", "spans", "item_ids"])

    return mark


def _longest(block):
    def longest(batches):
        items = block.value
        for held, _, shard in _shards(batches, items):
            length, lo, hi, _, _ = search(shard.a, shard.sa, items)
            doc, place, which = shard.where(lo, hi, np.flatnonzero(length >= items.window))
            columns = [pa.array([items.ids[i] for i in items.item[which]], pa.string()), pa.array(items.offset[which]), pa.array(length[which]), pa.array([held[d]["doc_id"] for d in doc], pa.int64()), pa.array(place - shard.starts[doc])]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_pos", "n_words", "doc_id", "doc_pos"])

    return longest


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) :
    """The number of blocks, and the benchmark block by block: of bounded size, broadcast, the one before given up by the driver."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head().n
    n = -(-total // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    send = rows.sparkSession.sparkContext.broadcast
    return n, (send(Items([(r.item_id, r.text) for r in rows.filter(part == k).collect()], window)) for k in range(n))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans (flat array of half-open word spans hit), item_ids.

    A null text has no words.  An item without words, a null text or a null item_id asks
    for nothing.  Items of fewer words than the window are one window.  Rows that repeat
    are judged each; an empty benchmark hits nothing.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    kind = next(t for c, t in rows.dtypes if c == "doc_id")
    arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    n, blocks = _blocks(benchmark, item_col, bench_text_col, window)
    for k, items in enumerate(blocks):
        rows = rows.select("doc_id", "text", "spans", "item_ids").mapInArrow(_mark(items, k + 1 == n, arrow), f"doc_id {kind}, text string, n_words long, spans array<long>, item_ids array<string>")
        if k + 1 < n:
            rows = scratch.cut(rows, f"pass-{k}")
            scratch.drop(f"pass-{k - 1}")
            items.unpersist()
    return rows.drop("text")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """For each item suffix that matches a window or more: the longest match over all shards and every place of it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in _blocks(benchmark, item_col, bench_text_col, window)[1]:
        part = rows.mapInArrow(_longest(items), "item_id string, item_pos long, n_words long, doc_id long, doc_pos long")
        found = part if found is None else found.unionByName(part)
    found = Scratch(docs.sparkSession, "matches").cut(found, "all")
    most = found.groupBy("item_id", "item_pos").agg(F.max("n_words").alias("n_words"))
    return found.join(most, ["item_id", "item_pos", "n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without a hit word, all columns as they are; a pass over the rows for each block, without a shuffle.

    A null text has no words and stays, repeated rows are judged alike, and an empty
    benchmark or table is no error.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    n, blocks = _blocks(benchmark, "item_id", "text", window)
    out = docs
    for k, items in enumerate(blocks):
        out = out.mapInArrow(_drop(items), docs.schema)
        if k + 1 < n:
            out = scratch.cut(out, f"pass-{k}")
            scratch.drop(f"pass-{k - 1}")
            items.unpersist()
    return out


def _drop(block):
    def drop(batches):
        items = block.value
        get = items.vocabulary.get
        for batch in batches:
            texts = [[get(w, 0) for w in words(t)] for t in batch.column("text").to_pylist()]
            total = np.cumsum([len(t) for t in texts])
            part = (total - 1) // SHARD_WORDS if len(texts) else total
            keep = np.ones(len(texts), bool)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                shard = Shard([texts[i] for i in rows], items)
                _, _, _, lo, hi = search(shard.a, shard.sa, items)
                lo, hi, _, _ = ranges(items, lo, hi)
                doc, _, _ = shard.where(lo, hi, np.arange(len(lo)))
                keep[rows[doc]] = False
            yield batch.filter(pa.array(keep))

    return drop


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")))["sum"]
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = None
