"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its five-word shingles as 128-bit hashes, of which the first
halves find candidates and both halves decide a link.  Documents of equal sets are one class, known by the set's 128-bit digest, so repeated and null identifiers play no
part until the end.  With a least overlap of t = ceil(0.75 n), two similar documents share
at least L shingles of their first n - t + L in any common order, for every L up to t.

First prefixes: rare shingles first, by a fixed-size count sketch, then by hash, with one L
for all.  Only prefixes are posted; a class that meets too few others there has no partner.
Of the classes left, the open ones, all shingles are counted exactly among one another.
One that a single open class holds is in no overlap: it is taken off, and classes with less
than 0.75 n left go.

Second prefixes: by exact count, then hash.  Each class takes the L that its candidate cost
(the lists it reads, and the verifications that remain when L must be shared) asks for.  In
lists over STAR members a pivot is compared with all members first, round by round, and
what joins a component is not paired again.  The pairs that still cross components must
share min(L, L') shingles, each early enough in both orders for the overlap that the
pair's own sizes need, before whole sets are verified.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, settings, table
from .graph import components

WORDS = 5
SKETCH_BITS = 22
CHUNK_BITS = 16
#: Sketches added up in one group.
FAN_IN = 64
#: L of the first prefixes is FIRST_SHARED + n // FIRST_PART, as far as the set's size allows.
FIRST_SHARED = 8
FIRST_PART = 8
#: Most L of the second ones.
MOST_SHARED = 40
#: Cost of a verification against that of reading a posting.
VERIFY_COST = 16.0
#: Lists longer than this meet a pivot first.
STAR = 24
ROUNDS = 3
#: Postings of one shingle in one partition; lists estimated longer are salted.
HOT_LIST = 200_000
#: Pairs of one document verified beside one copy of its set.
PAIRS_PER_COPY = 256
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed together; longer texts are cut at white space.
PIECE = 1 << 20


def _word_hashes(raw: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word of ASCII-lower-cased bytes: the sum of mixed values of (place in the word, byte), mixed with the length.

    The values follow from no recurrence, so no words cancel out by their structure.
    """
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    place = np.zeros(len(raw), np.int64)
    place[begin] = begin - np.concatenate(([0], begin[:-1]))
    v = (np.arange(len(raw)) - np.cumsum(place)).astype(np.uint64)  # the place in the word; what lies between words is not summed
    v <<= np.uint64(8)
    v |= raw
    v += np.uint64(seed)
    v *= _ODD[0]
    v ^= v >> np.uint64(32)
    v *= _ODD[3]
    v ^= v >> np.uint64(29)
    v *= _ODD[4]
    v ^= v >> np.uint64(32)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    h = total[end] - total[begin]
    h += size.astype(np.uint64) * _ODD[2]
    h ^= h >> np.uint64(31)
    h *= _ODD[3]
    h ^= h >> np.uint64(32)
    return h


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word."""
    data = np.frombuffer(raw, np.uint8)
    cuts, a = [], 0
    while a < len(data):
        b = min(a + PIECE, len(data))
        if b < len(data):
            gaps = np.flatnonzero(_SPACE[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[data[b:]])
                b = b + int(later[0]) if len(later) else len(data)
        cuts.append(data[a:b])
        a = b
    none = [np.zeros(0, np.uint64)]
    return tuple(np.concatenate([_word_hashes(c, seed) for c in cuts] or none) for seed in (1, 0x51ED270B0A1F39C1))


def _of_five(h: np.ndarray) -> np.ndarray:
    """A hash of each five words; of all words where they are fewer."""
    n = len(h)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], np.uint64)
    s = h[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        s = (s ^ (s >> np.uint64(29))) + h[k : n - WORDS + 1 + k] * _ODD[k]
    s ^= s >> np.uint64(32)
    s *= _ODD[1]
    s ^= s >> np.uint64(29)
    return s


def pairs_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles as 128 bits: the first halves, sorted, and the second ones beside them."""
    h1, h2 = _words((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h1):
        return h1, h2
    first, second = _of_five(h1), _of_five(h2)
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate(([True], first[1:] != first[:-1]))
    return first[new], second[order][new]


def shingles(text: str | None) -> np.ndarray:
    """First halves, which find candidates; fewer than five words are one shingle, none are no shingle."""
    return pairs_of(text)[0]


def digest(s: tuple[np.ndarray, np.ndarray]) -> bytes | None:
    """128 bits that stand for a set of 128-bit shingles; None for the empty one."""
    return xxhash.xxh3_128_digest(s[0].tobytes() + s[1].tobytes()) if len(s[0]) else None


def short(key: bytes) -> int:
    """The first 64 bits of a digest: enough to tell which classes meet others, where two that fall together do no harm."""
    return int.from_bytes(key[:8], "big", signed=True)


def row_name(doc_id, text):
    return F.xxhash64(doc_id, text)


def second_name(doc_id, text):
    """Rows are the same where both names are."""
    return F.xxhash64(F.lit("second"), text, doc_id)


def _first_pass(batches):
    """Per row its set's size and digest; per task the chunks of its count sketch."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    shift, held, loose = np.uint64(64 - SKETCH_BITS), [], 0
    names = ["rid", "sid", "doc_id", "n", "key", "cls", "chunk", "salt", "blob"]
    for batch in batches:
        n, keys = [], []
        for text in batch.column(3).to_pylist():
            both = pairs_of(text)
            s = both[0]
            n.append(len(s))
            keys.append(digest(both))
            if len(s):
                held.append((s >> shift).astype(np.int64))
            if (loose := loose + len(s)) > 1 << 20:
                counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                held, loose = [], 0
        m = len(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([k and short(k) for k in keys], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
    size = 1 << CHUNK_BITS
    blobs = [(c, zlib.compress(counts[c * size : (c + 1) * size].tobytes(), 1)) for c in range(1 << (SKETCH_BITS - CHUNK_BITS)) if counts[c * size : (c + 1) * size].any()]
    m = len(blobs)
    none = pa.nulls(m, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(m, pa.binary()), none, pa.array([c for c, _ in blobs], pa.int32()), pa.array([task] * m, pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names)


def _add_sketches(key, rows):
    """Sum of a chunk's counts, FAN_IN blobs at most."""
    total = np.zeros(1 << CHUNK_BITS, np.uint64)
    for b in rows.column("blob").to_pylist():
        total += np.frombuffer(zlib.decompress(b), np.uint32)
    out = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "blob": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})


def _levels(rows: DataFrame) -> np.ndarray:
    """The sketch of all documents as a level for each bucket: 0 for ordinary, else 1 + log2 of the excess count."""
    parts = rows.filter(F.col("chunk").isNotNull()).select("chunk", "salt", "blob")
    tasks = (parts.agg(F.max("salt")).head()[0] or 0) + 1
    while tasks > 1:
        parts = parts.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")).groupBy("chunk", "salt").applyInArrow(_add_sketches, "chunk int, salt int, blob binary")
        tasks = -(-tasks // FAN_IN)
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    size = 1 << CHUNK_BITS
    for r in parts.toLocalIterator():  # a fixed size, whatever the input: the sketch
        counts[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(r.blob), np.uint32)
    return _level_of(counts)


def _level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each bucket, a chunk at a time: the driver holds the sketch and its levels, and no further array of its length."""
    load, size = counts.mean(), 1 << CHUNK_BITS
    levels = np.zeros(len(counts), np.uint8)
    for a in range(0, len(counts), size):
        excess = counts[a : a + size] - load
        heavy = excess >= 8 * np.sqrt(load + 1) + 8
        levels[a : a + size] = np.where(heavy, 1 + np.log2(np.maximum(excess, 1)), 0)
    return levels


def first_prefix(s: np.ndarray, levels: np.ndarray):
    """Ordered shingles of the first prefix and their levels, how many of these count at the L that every partner has, and that L.

    A partner has 0.75 n shingles at least.
    """
    n = len(s)
    lv = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    least = (3 * n + 3) // 4
    base = n - least
    order = np.argsort(lv, kind="stable")[: base + min(FIRST_SHARED + n // FIRST_PART, least)]  # s is sorted
    low = min(FIRST_SHARED + 3 * n // (4 * FIRST_PART), -(-9 * n // 16))
    return s[order], lv[order], base + low, low


def _salts(doc: int, lv: np.ndarray, hot: int) -> np.ndarray:
    """Lists that the sketch holds for longer than ``hot`` are dealt out in parts from 1; others are part 0."""
    parts = np.where(lv > 0, np.exp2(lv.astype(np.float64)) // hot + 1, 1).astype(np.int64)
    return np.where(parts > 1, 1 + ((doc * 2654435761) & 0x7FFFFFFF) % parts, 0).astype(np.int32)


def _first_postings(levels_b, hot: int):
    """token, cls, salt, need: a class once a task as far as 100,000 are remembered; need is L, 0 where the shingle does not count at it."""

    def work(batches):
        levels, done = levels_b.value, set()
        for batch in batches:
            cols, held = ([], [], [], []), 0
            for text in batch.column(0).to_pylist():
                both = pairs_of(text)
                s = both[0]
                if not len(s):
                    continue
                cls = short(digest(both))
                if cls in done:
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add(cls)
                t, lv, count, low = first_prefix(s, levels)
                for col, v in zip(cols, (t.view(np.int64), np.full(len(t), cls, np.int64), _salts(cls, lv, hot), np.where(np.arange(len(t)) < count, low, 0).astype(np.int32))):
                    col.append(v)
                held += len(t)
                if held >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["token", "cls", "salt", "need"])
                    cols, held = ([], [], [], []), 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["token", "cls", "salt", "need"])

    return work


def _all_tokens(levels_b, hot: int):
    """Texts of open classes -> token, doc, n, est (what the sketch holds the list for), salt; other texts of one identifier are passed over."""

    def work(batches):
        levels, done = levels_b.value, set()
        for batch in batches:
            cols, held = ([], [], [], [], []), 0
            for text, key, doc in zip(*(batch.column(k).to_pylist() for k in range(3))):
                both = pairs_of(text)
                s = both[0]
                if doc in done or digest(both) != key:
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add(doc)
                n, lv = len(s), levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                for a in range(0, n, 200_000):
                    t, v = s[a : a + 200_000], lv[a : a + 200_000]
                    for col, x in zip(cols, (t.view(np.int64), np.full(len(t), doc, np.int64), np.full(len(t), n, np.int32), np.exp2(v.astype(np.float64)).astype(np.int64), _salts(doc, v, hot))):
                        col.append(x)
                    held += len(t)
                    if held >= 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["token", "doc", "n", "est", "salt"])
                        cols, held = ([], [], [], [], []), 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["token", "doc", "n", "est", "salt"])

    return work


def _sets(batches):
    """Texts -> the sets of the classes asked for; other texts of one identifier are passed over."""
    for batch in batches:
        docs, sets = [], []
        for text, key, doc in zip(*(batch.column(k).to_pylist() for k in range(3))):
            both = pairs_of(text)
            if digest(both) == key:
                docs.append(doc)
                sets.append(both[0].tobytes() + both[1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["doc", "s"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as rows of first halves and second ones (if any), are similar; a shingle is shared where all halves are."""
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    _, at, by = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int((a[1:, at] == b[1:, by]).all(0).sum())
    return 100 * both >= 75 * (a.shape[1] + b.shape[1] - both)


def _verify(batches):
    """Rows sorted by (x, part, y): first the sets of x (y null), then those to compare with them."""
    at, own = None, []
    for batch in batches:
        xs, parts, ys = (batch.column(k).to_pylist() for k in range(3))
        sets = batch.column(3)
        a, b = [], []
        for k in range(len(xs)):
            if (xs[k], parts[k]) != at:
                at, own = (xs[k], parts[k]), []
            s = np.frombuffer(sets[k].as_buffer(), np.uint64).reshape(2, -1)
            if ys[k] is None:
                own.append(s.copy())
            elif any(similar(o, s) for o in own):
                a.append(xs[k])
                b.append(ys[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, hot_list: int, star: int):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        text, doc = F.col(text_col), F.col(id_col).cast("long")
        self.docs = docs.select(row_name(doc, text).alias("rid"), second_name(doc, text).alias("sid"), doc.alias("doc_id"), text.alias("text"))
        self.hot_list, self.star = hot_list, star

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """text, key, doc of the rows named by ``classes`` (rid, key, doc and asked, which is 1).

        Only these texts move: Spark builds a Bloom filter of the names while that fits.
        """
        asked = classes.filter(F.col("asked") == 1).select(F.col("rid").alias("c_rid"), "key", "doc")
        return self.docs.join(asked.hint("merge"), F.col("rid") == F.col("c_rid")).select("text", "key", "doc")

    def few(self):
        return settings(self.spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0", spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="256m")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (x, y) whose whole sets are similar, as links (a, b)."""
        cut = self.scratch.cut
        pairs = cut(pairs, f"{name}-pairs")
        nodes = pairs.select(F.col("x").alias("doc")).unionByName(pairs.select(F.col("y").alias("doc"))).distinct()
        nodes = cut(self.open.join(nodes, "doc", "left_semi").select("rid", "key", "doc", "asked"), f"{name}-nodes")
        with self.few():
            sets = cut(self.texts_of(nodes).mapInArrow(_sets, "doc long, s binary"), f"{name}-sets")
        load = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("parts"))
        heads = load.join(sets, F.col("x") == F.col("doc")).select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("y"), "s")
        tails = pairs.join(load, "x").select("x", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"), "y").join(sets, F.col("y") == F.col("doc")).select("x", "part", "y", "s")
        rows = heads.unionByName(tails).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
        links = cut(rows.mapInArrow(_verify, "a long, b long"), f"{name}-links")
        self.scratch.drop(f"{name}-sets", f"{name}-nodes", f"{name}-pairs")
        return links

    def labelled(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """``rows`` with label: the component of doc, or doc itself."""
        if labels is None:
            return rows.withColumn("label", F.col("doc"))
        return rows.join(labels, F.col("doc") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "doc").alias("label"))

    def counted(self, held: DataFrame) -> DataFrame:
        """Shingles that two open classes hold, with c, the length of the list, and v, how many of them the class has; classes with v under 0.75 n go.

        Lists in parts have c from the sketch, the same for all that hold the shingle.
        """
        length = F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))
        rows = held.withColumn("c", F.when(F.col("salt") > 0, F.col("est")).otherwise(length)).filter((F.col("c") > 1) | (F.col("salt") > 0))
        return rows.withColumn("v", F.count(F.lit(1)).over(Window.partitionBy("doc"))).filter(4 * F.col("v") >= 3 * F.col("n"))

    def second_prefixes(self, held: DataFrame) -> DataFrame:
        """token, doc, n, v, pos, ell: the adaptive prefixes, by (c, token)."""
        order = Window.partitionBy("doc").orderBy("c", "token")
        rows = held.withColumn("pos", F.row_number().over(order)).withColumn("read", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        least, alike = F.ceil(0.75 * F.col("n")).cast("int"), F.ceil(F.col("n") * 6 / 7 - F.lit(1e-9)).cast("int")
        # The cost of each L is that of a partner of equal size; the prefix goes on as far as the smallest partner asks.
        ell = F.col("pos") - F.col("v") + alike
        cost = F.when(ell.between(1, F.least(F.lit(MOST_SHARED), least)), F.struct((F.col("read") * (1 + VERIFY_COST / ell)).alias("cost"), ell.alias("ell")))
        rows = rows.withColumn("best", F.when(F.col("v") < alike, 1).otherwise(F.coalesce(F.min(cost).over(Window.partitionBy("doc"))["ell"], F.lit(1))))
        return rows.filter(F.col("pos") - F.col("v") + least <= F.col("best")).select("token", "doc", "n", "v", "pos", F.col("best").alias("ell"))

    def meetings(self, rest: DataFrame) -> DataFrame:
        """x, y, m of pairs with different labels, once for each shingle within the prefixes that their sizes ask for at m = min(L, L').

        In each list, members of its largest label meet only the others.
        """
        labels = rest.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        major = labels.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", "major")
        rest = self.scratch.cut(rest.join(major, "token"), "mixed")
        other = rest.drop("major").select("token", *[F.col(c).alias(f"{c}2") for c in rest.columns if c not in ("token", "major")])
        m = F.least("ell", "ell2")
        need = F.ceil((F.col("n") + F.col("n2")) * 3 / 7 - F.lit(1e-9)).cast("int")
        apart = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("major")) | (F.col("doc") < F.col("doc2")))
        early = (F.col("pos") - F.col("v") + need <= m) & (F.col("pos2") - F.col("v2") + need <= m)
        sizes = 4 * F.least("n", "n2") >= 3 * F.greatest("n", "n2")
        met = rest.filter(F.col("label") != F.col("major")).join(other, "token").filter(apart & sizes & early & (F.least("v", "v2") >= need))
        return met.select(F.least("doc", "doc2").alias("x"), F.greatest("doc", "doc2").alias("y"), m.alias("m"))

    def crossing(self, rest: DataFrame) -> DataFrame:
        """Pairs (x, y) that meet m times."""
        met = self.meetings(rest).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("m"))
        return met.filter(F.col("c") >= F.col("m")).select("x", "y")

    def links(self) -> DataFrame | None:
        """Links between open classes that join all that is similar, directly or by others."""
        cut, drop = self.scratch.cut, self.scratch.drop
        links = labels = tried = None
        with self.few():
            held = self.texts_of(self.open).mapInArrow(_all_tokens(self.sketch, self.hot_list), "token long, doc long, n int, est long, salt int")
            once = cut(self.counted(held).select(*held.columns), "held")
        rest = cut(self.second_prefixes(self.counted(once)), "prefixes")
        drop("held")
        long_lists = rest.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > self.star).select("token")
        stars = cut(rest.join(long_lists, "token", "left_semi").select("token", "doc", "n", "v"), "stars")
        for k in range(ROUNDS if not stars.isEmpty() else 0):
            rows_k = self.labelled(stars, labels)
            # A pivot holds few shingles of its own, so that most of what it can join is near it.
            pivot = F.min(F.struct((F.col("n") - F.col("v")).alias("own"), "doc", "label", "n", "v")).alias("p")
            low = rows_k.groupBy("token").agg(pivot, F.min("label").alias("l0"), F.max("label").alias("l1")).filter(F.col("l0") != F.col("l1"))
            if labels is not None:  # the next pivot: the best member outside the first one's component
                low = rows_k.join(low, "token").filter(F.col("label") != F.col("p.label")).groupBy("token").agg(pivot)
            hope = (4 * F.least("n", "p.n") >= 3 * F.greatest("n", "p.n")) & (7 * F.least("v", "p.v") >= 3 * (F.col("n") + F.col("p.n")))
            pairs = rows_k.join(low.select("token", "p"), "token").filter((F.col("label") != F.col("p.label")) & hope)
            pairs = pairs.select(F.col("p.doc").alias("x"), F.col("doc").alias("y")).distinct()
            pairs = cut(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), f"star-{k}")
            if pairs.isEmpty():
                break
            tried = pairs if tried is None else tried.unionByName(pairs)
            fresh = self.verified(pairs, f"round-{k}")
            links = fresh if links is None else links.unionByName(fresh)
            labels = cut(components(links, self.scratch, f"cc-{k}"), f"labels-{k}")
        last = self.verified(self.crossing(self.labelled(rest, labels)), "last")
        return last if links is None else links.unionByName(last)

    def run(self) -> DataFrame:
        """rid, sid, doc_id, n, key and keep (the row that stands for the component) of each row."""
        cut, drop = self.scratch.cut, self.scratch.drop
        first = cut(self.docs.mapInArrow(_first_pass, "rid long, sid long, doc_id long, n long, key binary, cls long, chunk int, salt int, blob binary"), "first")
        self.sketch = self.spark.sparkContext.broadcast(_levels(first))
        rows = cut(first.filter(F.col("n").isNotNull()).select("rid", "sid", "doc_id", "n", "key", "cls"), "rows")
        drop("first")
        # The row that stands for a class: the least identifier, nulls last.
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "sid")).alias("r")
        classes = cut(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(least, F.min("cls").alias("cls")), "classes")
        postings = self.docs.select("text").mapInArrow(_first_postings(self.sketch, self.hot_list), "token long, cls long, salt int, need int")
        by = Window.partitionBy("token", "salt")
        shared = postings.withColumn("c0", F.min("cls").over(by)).withColumn("c1", F.max("cls").over(by)).filter(((F.col("c0") != F.col("c1")) | (F.col("salt") > 0)) & (F.col("need") > 0))
        shared = shared.groupBy("token", "salt", "cls").agg(F.max("need").alias("need"))
        hopeful = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).filter(F.col("c") >= F.col("need"))
        hopeful = cut(hopeful.select("cls"), "hopeful")
        opened = classes.join(hopeful, "cls", "left_semi").select("key", F.col("r.rid").alias("rid"))
        # Numbers are given once, as the table is written.
        self.open = cut(opened.withColumn("doc", F.monotonically_increasing_id()).withColumn("asked", F.lit(1)), "open")
        labels = components(self.links(), self.scratch, "cc")
        named = classes.join(self.open.select("key", "doc"), "key", "left").join(labels, F.col("doc") == F.col("node"), "left")
        alone = F.coalesce(F.col("component").cast("string"), F.hex("key"))
        named = cut(named.select("key", "r", alone.alias("group")), "named")
        keep = named.groupBy("group").agg(F.min("r").alias("keep"))
        named = named.join(keep, "group").select(F.col("key").alias("c_key"), "keep")
        out = rows.join(named, F.col("key") == F.col("c_key"), "left")
        own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "sid")
        return out.withColumn("keep", F.when(F.col("key").isNull(), own).otherwise(F.col("keep")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_list: int = HOT_LIST, star: int = STAR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Links: 100 * intersection >= 75 * union of the shingle sets.  A null or wordless text
    has no shingles and links with nothing: it is its own component.  Rows are told apart by
    their sets, never by doc_id: rows that repeat a doc_id with other texts are documents of
    their own, and rows with a null doc_id link like others.  component_id is the least
    doc_id of the component, null where all its rows have none.  An empty table gives no
    rows; other columns are not looked at.
    """
    return _Join(docs, id_col, text_col, hot_list, star).run().select("doc_id", F.col("n").alias("n_shingles"), F.col("keep.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, one of each component: that with the smallest doc_id, nulls last.

    Rows without shingles stay.  Of rows that repeat doc_id and text one stays.  All columns
    stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    kept = (F.col("rid") == F.col("keep.rid")) & (F.col("sid") == F.col("keep.sid"))
    decided = scratch.cut(_Join(docs, "doc_id", "text", HOT_LIST, STAR).run().select("rid", "sid", kept.alias("kept"), "n"), "decisions")
    gone = decided.filter(~F.col("kept")).select(F.col("rid").alias("gone_rid"), F.col("sid").alias("gone_sid")).distinct()
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own_row")
    doc = F.col("doc_id").cast("long")
    rows = docs.select(own, row_name(doc, F.col("text")).alias("own_rid"), second_name(doc, F.col("text")).alias("own_sid"))
    rows = rows.join(gone, (F.col("own_rid") == F.col("gone_rid")) & (F.col("own_sid") == F.col("gone_sid")), "left_anti")
    twice = decided.filter(F.col("kept") & (F.col("n") > 0)).groupBy("rid", "sid").count().filter("count > 1")
    twice = scratch.cut(twice.select(F.col("rid").alias("twice_rid"), F.col("sid").alias("twice_sid")), "twice")
    if not twice.isEmpty():
        same = (F.col("own_rid") == F.col("twice_rid")) & (F.col("own_sid") == F.col("twice_sid"))
        again = rows.join(twice, same, "left_semi").dropDuplicates(["own_rid", "own_sid"])
        rows = rows.join(twice, same, "left_anti").unionByName(again)
    return rows.select("own_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
