"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, each tree adding to the
feature's lookup table over its bins; then the pairs that explain most of what is left
get tables over pairs of coarse bins in the same way.  A score is a sum of table
entries through a logistic function, computed for whole batches.

The model is fitted on at most FIT_ROWS labelled rows, taken in the order of a hash of
doc_id; features, scores and decisions cover every row and the whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FIT_ROWS = 20_000
BINS = 48
COARSE = 8
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
LEAVES = 4
MIN_LEAF = 8
L2 = 2.0
THRESHOLD = 0.3

_KINDS = np.zeros(256, np.int64)  # 0 other control
for _b in range(256):
    _KINDS[_b] = 1 if 97 <= _b <= 122 else 2 if 65 <= _b <= 90 else 3 if 48 <= _b <= 57 else 4 if _b == 10 else 5 if _b in (9, 11, 12, 13, 32) else 6 if _b >= 128 else 7 if chr(_b) in ".,;:'\"()-?" else 8 if _b > 32 and _b < 127 else 0
_SENTENCE = re.compile(rb"[.?!]+(?=\s|$)")

FEATURES = (
    "log_bytes", "log_words", "word_length", "lower", "upper", "digit", "line_breaks", "blank", "wide", "stops", "signs",
    "most_sign", "bang", "bar", "distinct_words", "distinct_lines", "long_words", "short_words", "sentence_words", "line_words",
    "entropy", "distinct_pairs", "upper_words", "sign_words", "capital_words", "longest_word",
)


def features(text: str | None) -> list[float]:
    """Numbers of one whole text; all zeros for an empty or null one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KINDS, weights=by_byte, minlength=9) / n
    w = raw.split()
    m = len(w) or 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1, np.int64)
    p = by_byte[by_byte > 0] / n
    sentences = len(_SENTENCE.findall(raw)) or 1
    signs = by_byte * (_KINDS == 8)
    shouted = sum(map(bytes.isupper, w))
    plain = sum(map(bytes.isalpha, w))
    capital = sum(map(bytes.istitle, w))
    return [
        np.log1p(n), np.log1p(len(w)), n / m, kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[8],
        signs.max() / n, by_byte[33] / m, by_byte[124] / m, len(set(w)) / m, len(set(lines)) / (len(lines) or 1), (sizes > 12).sum() / m, (sizes < 3).sum() / m, m / sentences, m / (len(lines) or 1),
        float(-(p * np.log2(p)).sum()), len(set(zip(w, w[1:]))) / m, shouted / m, 1 - plain / m, capital / m, np.log1p(sizes.max()),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; everything that scoring needs."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, k], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, near the quantiles."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)
    return q[q > v.min()] if len(v) else q


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A shallow tree over ordered bins: gradients, curvatures and counts by bin -> a value for each bin."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + L2)
    cg, ch, cc = (np.concatenate(([0], np.cumsum(x))) for x in (g, h, c))
    for _ in range(LEAVES - 1):
        best = None
        for p in parts:
            a, b = p
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            left, right = gain(cg[m] - cg[a], ch[m] - ch[a]), gain(cg[b] - cg[m], ch[b] - ch[m])
            d = left + right - gain(cg[b] - cg[a], ch[b] - ch[a])
            d[(cc[m] - cc[a] < MIN_LEAF) | (cc[b] - cc[m] < MIN_LEAF)] = -1
            k = int(d.argmax())
            if d[k] > 1e-9 and (best is None or d[k] > best[0]):
                best = (d[k], p, a + 1 + k)
        if not best:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + L2)
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two-cut tree over a grid: gain and a value for each cell."""
    a, b = (np.zeros((g.shape[0] + 1, g.shape[1] + 1)) for _ in range(2))
    a[1:, 1:], b[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)
    total = 0
    for s in (a, b):
        nw, n, w, t = s[i, j], s[i, -1:][..., 0], s[-1:, j][0], s[-1, -1]
        quads = np.stack([nw, n - nw, w - nw, t - n - w + nw])
        total = (total, quads)
    qg, qh = total[0][1], total[1]
    d = (qg**2 / (qh + L2)).sum(0)
    k = np.unravel_index(int(d.argmax()), d.shape)
    v = (qg / (qh + L2))[:, k[0], k[1]]
    out = np.empty_like(g)
    x, y = k[0] + 1, k[1] + 1
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = v
    return float(d[k]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting; with one class or no rows, a constant."""
    n, f = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    edges, coarse = [_edges(x[:, k], BINS) for k in range(f)], [_edges(x[:, k], COARSE) for k in range(f)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [], base)
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    margin = np.full(n, base)
    for _ in range(ROUNDS):
        for k in range(f):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _tree(np.bincount(bins[k], y - p, len(counts[k])), np.bincount(bins[k], p * (1 - p), len(counts[k])), counts[k])
            model.tables[k] += step
            margin += step[bins[k]]
    grid = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    cell = lambda i, j: grid[i] * (len(coarse[j]) + 1) + grid[j]

    def sums(i, j, p):
        s = shape(i, j)
        return tuple(np.bincount(cell(i, j), v, s[0] * s[1]).reshape(s) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-margin))
    ranked = sorted(((_corner(*sums(i, j, p))[0], i, j) for i in range(f) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _corner(*sums(i, j, p))[1]
            t += step
            margin += step[grid[i], grid[j]]
    return model


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of FEATURES), one row per row."""

    def work(batches):
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, x array<float>")


def fold(doc_id) -> int:
    """crc32 of the identifier as text, mod 5."""
    return zlib.crc32(str(doc_id).encode()) % 5


def sample(marks: DataFrame, fit_rows: int, id_col: str) -> DataFrame:
    """At most ``fit_rows`` labelled rows outside the held-out fold, the first by a hash of the identifier.

    A bound on the hash, from the number of labels, leaves little more than that to sort.
    """
    marks = marks.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    n, order = marks.count(), F.xxhash64(id_col)
    wanted = fit_rows + 6 * fit_rows**0.5 + 16
    if n > wanted:
        marks = marks.filter(order < int(wanted / n * 2.0**64) - (1 << 63))
    return marks.orderBy(order, id_col).limit(fit_rows)


def train(feats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on the documents of ``sample``.

    A label that is null, or whose document has none, is left out; of several labels of
    a document the largest counts, of several rows of a document that with the least features.
    """
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).alias("y"))
    marks = sample(marks, fit_rows, "l_id")
    rows = feats.join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    rows = rows.orderBy(F.xxhash64("l_id"), "l_id").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64))


def score(feats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def work(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    kind = feats.schema["doc_id"].dataType.simpleString()
    out = feats.select("doc_id", "x").mapInArrow(work, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null or empty text has all features zero and gets the score of that point; a null
    doc_id is scored and never held out; rows that repeat are scored alike.  An empty
    ``labels`` gives the constant 0.5, an empty ``docs`` no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    feats = scratch.cut(feature_table(docs), "features")
    return score(feats, train(feats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, all columns as they are.

    Features are made for the sample that the model is fitted on (at most ``fit_rows``
    rows, so it is broadcast) and once more where rows are scored and filtered in place:
    no text is shuffled, and rows with a null doc_id are judged by their text too.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = Scratch(docs.sparkSession, "quality").cut(sample(marks, fit_rows, "doc_id"), "sample")
    ids = marks.select(F.col("doc_id").alias("m_id"))
    model = train(feature_table(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("m_id"))), marks, fit_rows)

    def work(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x.astype(np.float32).astype(np.float64)) >= threshold))

    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
