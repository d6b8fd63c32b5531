"""Suffix-array dedup: bytes covered by a 200-byte string that starts somewhere else too.

Suffixes are dealt out so that equal 200-byte strings meet: a string belongs to the
anchor that is the least of its hashed 40-grams, so equal strings have equal anchors at
equal offsets.  A stretch is a maximal run of string starts with one anchor.  Equal
stretches are kept once with a count; anchors that occur once are settled.  Of the
others, the suffixes are sorted by the difference-cover algorithm: triples at two of
three positions are sorted and named, the names are sorted by recursion, the remaining
suffixes are sorted by one symbol and the next rank and merged in; then adjacent
suffixes are compared over 200 bytes.  A symbol is eight bytes, so three levels reach
216 bytes.  Everything is cut from whole texts, whatever their length.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settings, table

LENGTH = 200
GRAM = 40
#: Bytes hashed together; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Bytes sorted together.
SORTED = 1 << 20
#: Distinct stretches of one anchor sorted in one task; beyond, strings are dealt out by their own hash.
HOT = 4096
STARTS = 161  # string starts of one anchor at most: LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _hash_powers(n: int):
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each position."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _hash_powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(7)) * up, dtype=np.uint64)))
    h = (total[length:] - total[:-length]) * down[: n - length + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` values in a row, by minima of blocks from both ends."""
    n = len(v)
    if n < w:
        return v[:0]
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(raw: np.ndarray, starts: np.ndarray):
    """Anchor hash, first string start and number of starts of each stretch; ``starts``: bool, where a string lies in one text."""
    h = gram_hashes(raw, GRAM)
    place = np.arange(len(h), dtype=np.uint64)
    low = sliding_min((h & ~np.uint64(0xFFFFFF)) | place, LENGTH - GRAM + 1)
    where = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = starts[: len(where)]
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    fresh = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(where[at]) != 0)))
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(at)))
    return h[where[at[first]]], at[first], size


def _pieces(texts: list[bytes]):
    """Groups of texts, or pieces of one, of about PIECE bytes: (buffer, index, offset in text, place in buffer, string starts)."""
    held, n = [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[a : a + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if n + len(part) > PIECE + 2048 and held:
                yield held
                held, n = [], 0
            held.append((k, a, part))
            n += len(part)
    if held:
        yield held


def _occurrences(batches):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        marks = [zlib.crc32(t) & 0xFFFFFF for t in texts]
        for held in _pieces(texts):
            data = b"".join(p for _, _, p in held)
            sizes = np.array([len(p) for _, _, p in held])
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            ok = np.ones(len(data), bool)
            for b, s in zip(begin, sizes):
                ok[b + s - LENGTH + 1 : b + s] = False
            anchor, first, count = stretches(np.frombuffer(data, np.uint8), ok)
            own = np.searchsorted(begin, first, side="right") - 1
            digest = xxhash.xxh3_64_intdigest
            ctx = np.array([digest(data[a : a + c + LENGTH - 1]) for a, c in zip(first.tolist(), count.tolist())], np.uint64)
            doc = [ids[held[o][0]] for o in own.tolist()]
            mark = np.array([marks[held[o][0]] for o in own.tolist()], np.int64)
            start = first - begin[own] + np.array([held[o][1] for o in own.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc, pa.int64()), pa.array(start), pa.array((mark << 8) | count)], ["anchor", "ctx", "doc", "start", "more"])


def _slices(batches):
    """Texts with the stretches wanted of them -> the stretches' bytes."""
    for batch in batches:
        out = [[], [], [], [], []]
        held = 0
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            mark = zlib.crc32(raw) & 0xFFFFFF
            for w in wanted:
                if w["more"] >> 8 != mark:
                    continue
                s = raw[w["start"] : w["start"] + (w["more"] & 255) + LENGTH - 1]
                for col, v in zip(out, (w["anchor"], w["ctx"], w["m"], w["k"], s)):
                    col.append(v)
                held += len(s)
            if held > 4 << 20:
                yield _slice_batch(out)
                out, held = [[], [], [], [], []], 0
        yield _slice_batch(out)


def _slice_batch(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "ctx", "m", "k", "s"])


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dense ranks of triples of small numbers."""
    top = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0)))
    if top < 1 << 21:
        key = (a << 42) | (b << 21) | c
    else:
        key = (np.unique((a << 32) | b, return_inverse=True)[1].astype(np.int64) << 32) | c
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def difference_cover_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of x (values >= 0) in the order of their suffixes, as far as ``depth`` values tell them apart."""
    n = len(x)
    if depth <= 1 or n < 4:
        if n < 4 and depth > 1:
            return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
        return np.argsort(x, kind="stable")
    v = np.concatenate((x + 1, np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names = _names(v[sample], v[sample + 1], v[sample + 2])
    if int(names.max()) + 1 < len(sample) and depth > 3:
        order = difference_cover_order(names, -(-depth // 3))
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rest = np.arange(0, n, 3)
    wide = np.int64(len(sample) + 2)
    rest = rest[np.argsort(v[rest] * wide + rank[rest + 1], kind="stable")]
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    is_one = sorted_sample % 3 == 1
    ones, twos = sorted_sample[is_one], sorted_sample[~is_one]
    under_one = np.searchsorted(np.maximum.accumulate(v[ones] * wide + rank[ones + 1]) if len(ones) else ones, v[rest] * wide + rank[rest + 1])
    pair = np.unique(np.concatenate((v[rest] * (v.max() + 1) + v[rest + 1], v[twos] * (v.max() + 1) + v[twos + 1])), return_inverse=True)[1].astype(np.int64)
    key_rest, key_two = pair[: len(rest)] * wide + rank[rest + 2], pair[len(rest) :] * wide + rank[twos + 2]
    under_two = np.searchsorted(np.maximum.accumulate(key_two) if len(twos) else key_two, key_rest)
    # Both counts grow along ``rest``; where equal prefixes leave them open, they are made to.
    place = np.maximum.accumulate(under_one + under_two) + np.arange(len(rest))
    out = np.empty(len(sorted_sample) + len(rest), np.int64)
    mask = np.zeros(len(out), bool)
    mask[place] = True
    out[mask], out[~mask] = rest, sorted_sample
    return out


def repeated_starts(parts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each stretch, whether the string at each of its starts occurs elsewhere: by its own count or in another stretch."""
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    raw = np.frombuffer(b"".join(parts) + bytes(240 + (-int(sizes.sum())) % 8), np.uint8)
    n = len(raw) // 8 * 8
    symbols = np.zeros(n, np.uint64)
    padded = np.concatenate((raw[:n], np.zeros(8, np.uint8))).astype(np.uint64)
    for k in range(8):
        symbols = (symbols << np.uint64(8)) | padded[k : k + n]
    x = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    rows = n // 8
    order = difference_cover_order(np.ascontiguousarray(x.reshape(rows, 8).T).ravel(), LENGTH // 8)
    order = (order % rows) * 8 + order // rows
    valid = np.zeros(n, bool)
    for b, s in zip(begin, sizes):
        valid[b : b + s - LENGTH + 1] = True
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in range(0, LENGTH, 8):
        same = same[x[a[same] + k] == x[b[same] + k]]
    hit = np.zeros(n, bool)
    hit[a[same]] = True
    hit[b[same]] = True
    return [np.ones(s - LENGTH + 1, bool) if c > 1 else hit[b : b + s - LENGTH + 1] for b, s, c in zip(begin, sizes, counts)]


def _runs(hit: np.ndarray) -> list[int]:
    """Half-open runs of True, flat."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def _sorted(batches):
    """Stretches ordered by anchor -> runs of repeated starts; an anchor is never split."""
    held, n = [], 0

    def done():
        runs = [_runs(r) for r in repeated_starts([h[3] for h in held], [h[2] for h in held])]
        keep = [k for k, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in keep], pa.int64()), pa.array([held[k][1] for k in keep], pa.int64()), pa.array([runs[k] for k in keep], pa.list_(pa.int32()))], ["anchor", "ctx", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if n >= SORTED and held[-1][0] != row[0]:
                yield done()
                held, n = [], 0
            held.append(row)
            n += len(row[3])
    if held:
        yield done()


def _strings(batches):
    """Stretches of hot anchors -> each string's offset from the anchor and hash."""
    for batch in batches:
        for anchor, ctx, m, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = np.frombuffer(s, np.uint8)
            h = gram_hashes(raw, LENGTH).view(np.int64)
            c = len(h)
            yield pa.RecordBatch.from_arrays([pa.array([anchor] * c, pa.int64()), pa.array([ctx] * c, pa.int64()), pa.array([m] * c, pa.int64()), pa.array(np.arange(c), pa.int32()), pa.array(h), pa.array([xxhash.xxh3_64_intdigest(s[i : i + LENGTH]) - (1 << 63) for i in range(c)], pa.int64())], ["anchor", "ctx", "m", "at", "h", "g"])


def removed(text: bytes, spans: list[list[int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, what is left; spans: flat runs of byte ranges."""
    cover = np.zeros(len(text) + 1, np.int32)
    flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
    np.add.at(cover, flat[:, 0], 1)
    np.add.at(cover, flat[:, 1], -1)
    gone = np.cumsum(cover[:-1]) > 0
    edges = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    return int(gone.sum()), int((edges == 1).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def _finish(with_text: bool):
    def finish(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone, runs, kept = removed(raw, spans) if spans else (0, 0, raw)
                for col, v in zip(out, (doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                    col.append(v)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return finish


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT):
    """Byte ranges to remove: (doc, mark, spans), spans a list of flat half-open ranges; mark tells texts of one identifier apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    cut = scratch.cut
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = cut(rows.mapInArrow(_occurrences, "anchor long, ctx long, doc long, start long, more long"), "seen")
    again = cut(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "again").filter(F.col("n") > 1)
    few = dict(spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0", spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="256m")
    with settings(spark, **few):
        hits = cut(seen.join(again.withColumnRenamed("anchor", "a"), F.col("anchor") == F.col("a")).drop("a", "n"), "hits")
    scratch.drop("seen", "again")
    kinds = hits.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc", "start", "more")).alias("at"))
    kinds = cut(kinds, "kinds")
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"))
    kinds = cut(kinds.join(per.withColumnRenamed("anchor", "a"), F.col("anchor") == F.col("a")).drop("a"), "kinds-k")
    alone = kinds.filter((F.col("k") == 1) & (F.col("m") > 1)).select("anchor", "ctx", F.array(F.lit(0), F.col("at.more").bitwiseAND(F.lit(255)).cast("int")).alias("runs"))
    several = kinds.filter(F.col("k") > 1)
    wanted = several.groupBy(F.col("at.doc").alias("w_doc")).agg(F.collect_list(F.struct("anchor", "ctx", "m", "k", F.col("at.start").alias("start"), F.col("at.more").alias("more"))).alias("wanted"))
    wanted = cut(wanted.withColumn("one", F.lit(1)), "wanted").filter(F.col("one") == 1)
    with settings(spark, **few):
        texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc"))).select("text", "wanted")
        slices = cut(texts.mapInArrow(_slices, "anchor long, ctx long, m long, k long, s binary"), "slices", compression="zstd")
    scratch.drop("wanted")
    tame = slices.filter(F.col("k") <= hot).select("anchor", "ctx", "m", "s").repartition("anchor").sortWithinPartitions("anchor", "ctx")
    settled = alone.unionByName(cut(tame.mapInArrow(_sorted, "anchor long, ctx long, runs array<int>"), "settled"))
    wild = slices.filter(F.col("k") > hot).select("anchor", "ctx", "m", "s")
    if not wild.isEmpty():
        strings = cut(wild.mapInArrow(_strings, "anchor long, ctx long, m long, at int, h long, g long"), "strings")
        twice = strings.groupBy("anchor", "h", "g").agg(F.sum("m").alias("n")).filter(F.col("n") > 1)
        found = strings.join(twice, ["anchor", "h", "g"]).select("anchor", "ctx", "at").distinct()
        settled = settled.unionByName(found.groupBy("anchor", "ctx").agg(F.flatten(F.transform(F.collect_list("at"), lambda i: F.array(i, i + 1))).alias("runs")))
    settled = settled.select(F.col("anchor").alias("s_anchor"), F.col("ctx").alias("s_ctx"), "runs")
    spans = hits.join(settled, (F.col("anchor") == F.col("s_anchor")) & (F.col("ctx") == F.col("s_ctx")))
    shifted = F.transform("runs", lambda x, i: (x + F.col("start") + F.when(i % 2 == 1, LENGTH - 1).otherwise(0)).cast("long"))
    spans = spans.select("doc", F.shiftright("more", 8).cast("int").alias("mark"), shifted.alias("span"))
    return spans.groupBy("doc", "mark").agg(F.collect_list("span").alias("spans"))


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for every row.

    A byte goes if a 200-byte string that covers it starts anywhere else, in the same text
    or another, rows that repeat included; all strings are judged on the input.  A null
    text is empty; texts under 200 bytes lose nothing.  Rows with a null doc_id count and
    are cut like others.  An empty table gives no rows; other columns are not looked at.
    """
    spans = repeats(docs, id_col, text_col, hot)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    mark = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("doc")) & (mark == F.col("mark")), "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(_finish(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
