"""Language model scores: a causal self-attention model in numpy over subword ids, beside a word-count base.

Texts are cut into blocks with a dictionary each (``blocks``); a dictionary word is encoded
by a byte-level BPE once, with the space before it.  From all training texts Spark counts
words (for the base) and subword ids (for the model's vocabulary), and deals all windows of
these texts out to shards and rounds, a chunk of a text at a time.  The model learns from each
of them: the shards of a round are trained side by side from the same weights, which are then
averaged, ROUNDS times.

The model sees the 16 inputs before a window beside the window's own 16: windows overlap
in their context, and every token is scored once.  The ids of most use are leaves of a
two-level output (a class, then a place in it; classes by bisecting the ids' contexts);
the other ids share the last leaf and are told apart by their corpus-wide counts.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .align import _spread
from .blocks import BLOCK_BYTES, Codes, in_blocks, pack, unpack
from .common import Scratch, table

BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary; a fixed value.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HELD_OUT = 10
#: Tokens of a window; its context is as long.
SPAN = 16
HEADS, HEAD = 2, 16
WIDTH = HEADS * HEAD
CLASSES = 32
LEAVES = CLASSES * CLASSES
PAD, BOS = LEAVES, LEAVES + 1
#: The same as 16-bit subword ids.
PAD_ID, BOS_ID = 0xFFFF, 0xFFFE
#: Text bytes of a shard, and windows of a text that go to one shard and round together.
SHARD_BYTES = 16 << 20
CHUNK = 32
ROUNDS = 4
#: Windows of small samples are gone over several times, until so many are seen or MOST_PASSES made.
SEEN = 1 << 18
MOST_PASSES = 6
#: Spans of 16 tokens of a step: fewer where a round would have less than STEPS steps.  The rate is that of 64, and grows with the root of their number.
BATCH, LEAST_BATCH, STEPS = 512, 64, 256
RATE_OF_LEARNING = 0.01
#: Spans whose attention is worked out at once: their arrays stay in a core's cache.
BLOCK = 64
FAN_IN = 32
#: Contexts that tell ids apart when classes are formed: the most frequent ones, and one for the rest.
CONTEXTS = 256
_NEVER = -1e4
_F = np.float32


# Vocabulary -----------------------------------------------------------------


class Subwords:
    """Words to subword ids."""

    def __init__(self, file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.size = max(ranks.values()) + 1
        self.end = self.size
        if self.end >= BOS_ID:
            raise ValueError(f"vocabularies of at most {BOS_ID - 1} ids are held in 16 bits")
        self.lengths = np.zeros(self.size, np.int64)
        for token, k in ranks.items():
            self.lengths[k] = len(token)
        self.code = tiktoken.Encoding("scores", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[bytes], chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each): every word by itself, with a space before it."""
        ids, sizes = [], []
        for a in range(0, len(words), chunk):
            part = words[a : a + chunk]
            text = b" ".join(part).decode("utf-8", "replace")
            got = None
            if not re.search(r"[^\S ]", text):
                got = np.array(self.code.encode_ordinary(" " + text), np.int64)
                ends, want = np.cumsum(self.lengths[got]), np.cumsum([len(w) + 1 for w in part])
                at = np.searchsorted(ends, want)
                if at[-1] < len(ends) and (ends[at] == want).all():
                    ids.append(got)
                    sizes.append(np.diff(at, prepend=-1))
                    continue
            each = [self.code.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in part]
            ids.append(np.array([x for e in each for x in e], np.int64))
            sizes.append(np.array([len(e) for e in each], np.int64))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(ids or none), np.concatenate(sizes or none)


_loaded: dict[bytes, Subwords] = {}


def loaded(file) -> Subwords:
    key = hashlib.sha256(file.value).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Subwords(file.value)
    return _loaded[key]


class Vocabulary:
    """Leaves of the ids by frequency, and the share of an id in its leaf; counts are those of all training texts."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.leaf = np.minimum(rank, LEAVES - 1)
        weight = counts + 0.1
        self.mass = np.bincount(self.leaf, weights=weight, minlength=LEAVES) + 1e-9
        self.inner = np.log(weight / self.mass[self.leaf])
        self.inputs = np.full(1 << 16, PAD, np.int64)
        self.inputs[: len(counts)] = self.leaf
        self.inputs[BOS_ID] = BOS
        self.targets = np.full(1 << 16, -1, np.int64)
        self.targets[: len(counts)] = self.leaf


def classes(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place) of each leaf: halves along the main axis of what stands before the leaves, again and again."""
    share = np.sqrt(contexts / np.maximum(contexts.sum(1, keepdims=True), 1))
    parts = [np.arange(LEAVES)]
    while len(parts) < CLASSES:
        halves = []
        for p in parts:
            z = share[p] - share[p].mean(0)
            axis = np.linalg.eigh(z.T @ z)[1][:, -1]
            axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
            order = np.argsort(np.round(z @ axis, 9), kind="stable")
            halves += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = halves
    cls, place = np.empty(LEAVES, np.int64), np.empty(LEAVES, np.int64)
    for c, p in enumerate(parts):
        cls[p], place[p] = c, np.arange(len(p))
    return cls, place


# Model ----------------------------------------------------------------------

_DISTANCE = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None]
_SEEN = _DISTANCE >= 0
_MASK = np.where(_SEEN, 0, _NEVER).astype(_F)
_AT = np.clip(_DISTANCE, 0, 2 * SPAN - 1)
#: The last value is one (it counts the weights), the last query one (it takes the key's bias).
_SHAPES = {
    "skip": (LEAVES + 2, WIDTH), "query": (HEADS, LEAVES + 2, HEAD), "key": (HEADS, LEAVES + 2, HEAD), "value": (HEADS, LEAVES + 2, HEAD), "far": (HEADS, 2 * SPAN),
    "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,), "to_place": (CLASSES, WIDTH, CLASSES), "place_bias": (CLASSES, CLASSES),
}


def fresh(vocabulary: Vocabulary, cls: np.ndarray, place: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """First weights: small random ones; output biases are the corpus-wide log shares."""
    r = np.random.default_rng(seed)
    scale = {"skip": 0.3, "query": 0.3, "key": 0.3, "value": 0.1, "to_class": 0.2, "to_place": 0.2}
    p = {k: r.normal(0, scale.get(k, 0), s) for k, s in _SHAPES.items()}
    p["far"][:] = -0.1 * np.arange(2 * SPAN)
    share = vocabulary.mass / vocabulary.mass.sum()
    p["class_bias"] = np.log(np.bincount(cls, weights=share, minlength=CLASSES))
    p["place_bias"][cls, place] = np.log(share)
    p["query"][:, :, -1] = p["value"][:, :, -1] = 1
    p["key"][:, :, -1] = 0
    p["key"][:, PAD, -1] = _NEVER
    return {k: v.astype(_F) for k, v in p.items()}


def to_blob(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in _SHAPES]).astype(_F).tobytes()


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Weights as parts of one array."""
    out, a = {}, 0
    for k, s in _SHAPES.items():
        n = math.prod(s)
        out[k] = flat[a : a + n].reshape(s)
        a += n
    return out


def from_blob(blob: bytes) -> dict[str, np.ndarray]:
    return views(np.frombuffer(blob, _F).copy())


def _shares(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of logits and their sums by row, up to one factor a row, and the logs of the whole sums; shifted only where a batch needs it."""
    one = np.ones(logits.shape[1], logits.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = e @ one
    if _sound(total):
        return e, total, np.log(total)
    top = logits.max(1, keepdims=True)
    e = np.exp(logits - top)
    total = e @ one
    return e, total, np.log(total) + top[:, 0]


class Attention:
    """Both heads over consecutive spans: each token attends to those of its span up to itself and to the span before.

    Keys and values of two spans are views of the rows of all, or of these rows turned, so
    that each token's are looked up once.
    """

    def __init__(self, p):
        self.rows = np.concatenate([*p["key"], *p["value"], *p["query"]], axis=1).reshape(LEAVES + 2, 3 * HEADS, HEAD)
        self.turned = np.ascontiguousarray(self.rows[:, : 2 * HEADS].reshape(LEAVES + 2, -1).T)
        self.bias = (p["far"][:, _AT] + _MASK).astype(p["far"].dtype)

    @staticmethod
    def blocks(n: int):
        return (slice(a, a + BLOCK) for a in range(0, n, BLOCK))

    def look_up(self, x: np.ndarray, values: bool):
        """Queries of all spans of ``x`` but the first, and keys and values of each with the span before it; ``values``: these turned, too."""
        n = len(x) - 1
        rows = self.rows.take(x.ravel(), 0)
        r = rows.strides
        two = lambda part: np.lib.stride_tricks.as_strided(part, (n, HEADS, 2 * SPAN, HEAD), (SPAN * r[0], r[1], r[0], r[2]), writeable=False)
        turned = self.turned[: (1 + values) * WIDTH].take(x.ravel(), 1).reshape(-1, HEAD, x.size)
        t = turned.strides
        across = lambda part: np.lib.stride_tricks.as_strided(part, (n, HEADS, HEAD, 2 * SPAN), (SPAN * t[2], t[0], t[1], t[2]), writeable=False)
        queries = rows[SPAN:, 2 * HEADS :].reshape(n, SPAN, HEADS, HEAD).transpose(0, 2, 1, 3)
        return queries, two(rows[:, :HEADS]), two(rows[:, HEADS:]), across(turned), across(turned[HEADS:]) if values else None

    def weigh(self, q, v, k_turned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of the logits, values averaged by them, and their sums: the last value is one, so its sum is that of the weights."""
        for shifted in (False, True):
            e, c = np.empty((len(q), HEADS, SPAN, 2 * SPAN), q.dtype), np.empty(q.shape, q.dtype)
            with np.errstate(over="ignore", invalid="ignore"):
                for s in self.blocks(len(q)):
                    a = np.matmul(q[s], k_turned[s], out=e[s])
                    a += self.bias
                    if shifted:
                        a -= a.max(-1, keepdims=True)
                    np.exp(a, out=a)
                    np.matmul(a, v[s], out=c[s])
            total = c[..., -1:].copy()
            if _sound(total):
                break
        c /= total
        return e, c, total


def gradient(p, x: np.ndarray, y: np.ndarray, cls: np.ndarray, place: np.ndarray):
    """``slope`` over windows, each by itself: x (n, 32) inputs, y (n, 16) leaves, -1 for none."""
    spans = np.full((2 * len(y), SPAN), -1, np.int64)
    spans[1::2] = y
    ll, g = slope(p, x.reshape(-1, SPAN), spans[1:], cls, place)
    return ll, views(g)


def slope(p, x: np.ndarray, y: np.ndarray, cls: np.ndarray, place: np.ndarray):
    """(log probabilities of the targets, in the order of their classes; gradients of their mean loss as one array).

    x (n + 1, 16): inputs of consecutive spans, the first one context only; y (n, 16): leaves of
    the others, -1 for none.  Texts follow one another: the first span of each has no targets.
    """
    n, flat, dtype = len(y), x.ravel(), p["skip"].dtype
    ok = np.flatnonzero(y.ravel() >= 0)
    ok = ok[np.argsort(cls[y.ravel()[ok]].astype(np.uint8), kind="stable")]
    leaf = y.ravel()[ok]
    c, t, m, rows = cls[leaf], place[leaf], len(ok), np.arange(len(ok))
    one = np.ones(max(m, flat.size), dtype)
    attention = Attention(p)
    q, k, v, k_turned, v_turned = attention.look_up(x, True)
    e, mean, total = attention.weigh(q, v, k_turned)
    hidden = p["skip"].take(flat[SPAN:], 0)
    by_head = lambda a: a.reshape(n, SPAN, HEADS, HEAD).transpose(0, 2, 1, 3)
    by_head(hidden)[:] += mean
    np.maximum(hidden, 0, out=hidden)
    z = hidden.take(ok, 0)

    logits = z @ p["to_class"]
    logits += p["class_bias"]
    ll = logits[rows, c]
    share, sums, logs = _shares(logits)
    ll -= logs
    cut = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    parts = [(j, slice(a, b)) for j, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
    logits = np.empty((m, CLASSES), dtype)
    for j, s in parts:
        np.matmul(z[s], p["to_place"][j], out=logits[s])
        logits[s] += p["place_bias"][j]
    ll += logits[rows, t]
    inner, inner_sums, logs = _shares(logits)
    ll -= logs
    share *= (1 / (m * sums))[:, None]
    share[rows, c] -= dtype.type(1 / m)
    inner *= (1 / (m * inner_sums))[:, None]
    inner[rows, t] -= dtype.type(1 / m)

    out = np.zeros(sum(map(math.prod, _SHAPES.values())), dtype)
    g = views(out)
    g["to_class"][:], g["class_bias"][:] = z.T @ share, one[:m] @ share
    back = share @ p["to_class"].T
    for j, s in parts:
        g["to_place"][j], g["place_bias"][j] = z[s].T @ inner[s], one[: s.stop - s.start] @ inner[s]
        back[s] += inner[s] @ p["to_place"][j].T
    back *= z > 0
    # What an input's rows get stands side by side, so that inputs are sorted once: skip, query, key, value.
    at = np.empty((n + 1, SPAN, 4 * HEADS, HEAD), dtype)
    at[0, :, : 2 * HEADS] = at[-1, :, 2 * HEADS :] = 0
    at_hidden = np.zeros((n * SPAN, WIDTH), dtype)
    at_hidden[ok] = back
    at[1:, :, :HEADS] = at_hidden.reshape(n, SPAN, HEADS, HEAD)
    d = by_head(at_hidden) / total
    # The last value is one: what every weight loses by the others stands there.
    d[..., -1] = -np.einsum("nhsd,nhsd->nhs", d[..., :-1], mean[..., :-1])
    own = np.empty((n, SPAN, 2 * HEADS, HEAD), dtype)
    turn = lambda a: a.transpose(0, 2, 1, 3)
    at_q, k_far, v_far, k_own, v_own = turn(at[1:, :, HEADS : 2 * HEADS]), turn(at[:-1, :, 2 * HEADS : 3 * HEADS]), turn(at[:-1, :, 3 * HEADS :]), turn(own[:, :, :HEADS]), turn(own[:, :, HEADS:])
    far = np.zeros(attention.bias.shape, dtype)
    for s in attention.blocks(n):
        a = d[s] @ v_turned[s]
        a *= e[s]
        far += a.sum(0)
        np.matmul(a, k[s], out=at_q[s])
        a, w = a.swapaxes(-1, -2), e[s].swapaxes(-1, -2)
        np.matmul(a[:, :, :SPAN], q[s], out=k_far[s])
        np.matmul(a[:, :, SPAN:], q[s], out=k_own[s])
        np.matmul(w[:, :, :SPAN], d[s], out=v_far[s])
        np.matmul(w[:, :, SPAN:], d[s], out=v_own[s])
    at[1:, :, 2 * HEADS :] += own
    for h in range(HEADS):
        g["far"][h] = np.bincount(_AT[_SEEN], weights=far[h][_SEEN], minlength=2 * SPAN)
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    at, ids = at.reshape(flat.size, -1).take(order, 0), flat[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    by_input = np.zeros((LEAVES + 2, 4 * WIDTH), dtype)
    for i, a, b in zip(ids[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
        np.dot(one[: b - a], at[a:b], out=by_input[i])
    by_input = by_input.reshape(LEAVES + 2, 4, HEADS, HEAD).transpose(1, 2, 0, 3)
    g["skip"].reshape(LEAVES + 2, HEADS, HEAD)[:] = by_input[0].transpose(1, 0, 2)
    g["query"][:], g["key"][:], g["value"][:] = by_input[1:]
    g["query"][:, :, -1] = g["value"][:, :, -1] = 0
    g["key"][:, PAD] = 0
    return ll, out


def spans_of(lines: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of lines of ids, one after the other, as ``slope`` takes them."""
    first = np.cumsum([0, *(len(x) // SPAN for x in lines[:-1])])
    x = vocabulary.inputs.take(np.concatenate([x[:-1] for x in lines])).reshape(-1, SPAN)
    y = vocabulary.targets.take(np.concatenate([x[1:] for x in lines])).reshape(-1, SPAN)
    y[first] = -1
    return x, y[1:]


def train(p, lines: list[np.ndarray], vocabulary: Vocabulary, cls, place, rounds: int, at: int, passes: int):
    """Weights after one round (``at`` of ``rounds``) over all windows of this shard's lines of the round."""
    flat = np.frombuffer(to_blob(p), _F).copy()
    p, mean, square, part = views(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    size, step = np.array([len(x) // SPAN - 1 for x in lines]), 0
    batch = min(BATCH, max(LEAST_BATCH, passes * int(size.sum()) // STEPS))
    for k in range(passes):
        order = np.random.default_rng((at, k)).permutation(len(lines))
        ends = np.cumsum(size[order])
        batches = np.split(order, np.unique(np.searchsorted(ends, np.arange(batch, ends[-1], batch)) + 1)[: len(lines)])
        batches = [b for b in batches if len(b)]
        for j, b in enumerate(batches):
            _, g = slope(p, *spans_of([lines[i] for i in b], vocabulary), cls, place)
            step += 1
            done = (k + j / len(batches)) / passes
            speed = RATE_OF_LEARNING * math.sqrt(batch / LEAST_BATCH) * (1 - (at + done) / rounds) * min(1, step / 30)
            mean *= _F(0.9)
            np.multiply(g, _F(0.1), out=part)
            mean += part
            g *= g
            g *= _F(0.01)
            square *= _F(0.99)
            square += g
            if step % 64 == 0:  # what is left of old gradients must not become subnormal: such numbers are slow
                mean[np.abs(mean) < 1e-30] = 0
                square[square < 1e-30] = 0
            np.sqrt(square, out=part)
            part *= _F(1 / math.sqrt(1 - 0.99**step))
            part += _F(1e-8)
            np.divide(mean, part, out=part)
            part *= _F(speed / (1 - 0.9**step))
            flat -= part
            p["query"][:, :, -1] = p["value"][:, :, -1] = 1
            p["key"][:, PAD, -1] = _NEVER
    return p


def line_of(tokens: np.ndarray) -> np.ndarray:
    """A text's tokens after padding and the text's begin (17 ids), padded to whole spans of 16."""
    line = np.full(SPAN + 1 + -(-len(tokens) // SPAN) * SPAN, PAD_ID, "<u2")
    line[SPAN] = BOS_ID
    line[SPAN + 1 : SPAN + 1 + len(tokens)] = tokens
    return line


def windows_of(tokens: np.ndarray) -> np.ndarray:
    """Rows of 33 ids for each 16 of a text's tokens: the 17 before (the text's begin and padding where there are fewer), then the 16."""
    return np.lib.stride_tricks.sliding_window_view(line_of(tokens), 2 * SPAN + 1)[::SPAN]


def _sound(total: np.ndarray) -> bool:
    """Whether sums of plain exponentials are far from overflow and underflow."""
    return bool(total.min() > 1e-25 and total.max() < 1e30) if total.size else True


class Scorer:
    """Log probabilities of texts by a trained model: batched masked attention, every token once."""

    #: Windows in one batch: its arrays stay in a core's cache.
    STEP = 512

    def __init__(self, p, vocabulary: Vocabulary, cls, place):
        self.p, self.vocabulary, self.cls, self.place = p, vocabulary, cls, place
        self.attention = Attention(p)

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        """x: consecutive spans of inputs, the first one context only."""
        q, _, v, k_turned, _ = self.attention.look_up(x, False)
        _, c, _ = self.attention.weigh(q, v, k_turned)
        out = self.p["skip"].take(x[1:], 0)
        out.reshape(len(q), SPAN, HEADS, HEAD).transpose(0, 2, 1, 3)[:] += c
        return np.maximum(out, 0, out=out)

    def _leaves(self, z: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Log probabilities of leaves, given hidden rows."""
        p, c, t, rows = self.p, self.cls[leaf], self.place[leaf], np.arange(len(z))
        logits = z @ p["to_class"]
        logits += p["class_bias"]
        ll = logits[rows, c] - _shares(logits)[2]
        order = np.argsort(c.astype(np.uint8), kind="stable")
        cut, zs = np.searchsorted(c[order], np.arange(CLASSES + 1)), z[order]
        inner = np.empty((len(z), CLASSES), _F)
        for k in range(CLASSES):
            s = slice(cut[k], cut[k + 1])
            if cut[k] < cut[k + 1]:
                np.matmul(zs[s], p["to_place"][k], out=inner[s])
                inner[s] += p["place_bias"][k]
        ll[order] += inner[rows, t[order]] - _shares(inner)[2]
        return ll

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``ids`` holds the texts' ids one after the other, ``sizes`` their numbers, one at least."""
        spans = -(-sizes // SPAN) + 1  # a span of padding before each text
        first = np.concatenate(([0], np.cumsum(spans)))
        x = np.full((first[-1], SPAN), PAD, np.int64)
        y = np.full((first[-1], SPAN), -1, np.int64)
        begin = (first[:-1] + 1) * SPAN
        at, leaf = _spread(begin, sizes), self.vocabulary.leaf[ids]
        y.reshape(-1)[at] = leaf
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        x.reshape(-1)[at[~last] + 1] = leaf[~last]
        x.reshape(-1)[begin] = BOS
        ll = np.zeros(x.size, np.float64)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for a in range(1, len(x), self.STEP):
                b = min(a + self.STEP, len(x))
                ok = np.flatnonzero(y[a:b].ravel() >= 0)
                if len(ok):
                    ll[a * SPAN + ok] = self._leaves(self._hidden(x[a - 1 : b]).reshape(-1, WIDTH)[ok], y[a:b].ravel()[ok])
        total = np.add.reduceat(ll, first[:-1] * SPAN) if len(sizes) else np.zeros(0)
        inner = np.add.reduceat(self.vocabulary.inner[ids], np.cumsum(sizes) - sizes) if len(sizes) else 0
        return (total + inner) / math.log(10)


# Spark ----------------------------------------------------------------------

_FIELDS = [
    ("block", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("held_out", "boolean", pa.bool_()), ("codes", "binary", pa.binary()),
    ("ids", "binary", pa.binary()), ("id_sizes", "binary", pa.binary()),
    ("word", "binary", pa.binary()), ("code", "int", pa.int32()), ("n", "long", pa.int64()),
    ("id", "int", pa.int32()), ("id_n", "long", pa.int64()),
    ("shard", "long", pa.int64()), ("round", "int", pa.int32()), ("lines", "binary", pa.binary()), ("line_sizes", "binary", pa.binary()),
]
_BLOCKS = pa.schema([(name, kind) for name, _, kind in _FIELDS])


def _rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _BLOCKS], schema=_BLOCKS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _read_blocks(file, limit: int, shards: int, rounds: int):
    """doc_id, held_out, text -> rows of documents, dictionaries, words, subword ids and all training windows."""

    def work(batches):
        subwords = loaded(file)
        for block, rows in in_blocks(batches, "text", limit):
            codes, docs, names, held_out = Codes(), [], [], rows["held_out"].to_pylist()
            for doc_id, raw in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                docs.append(codes.get(raw.lower().split()))
                names.append(xxhash.xxh64_intdigest(raw, (doc_id or 0) & 0xFFFFFFFF))
            words = list(codes.of)
            ids, sizes = subwords.encode(words)
            first = np.cumsum(sizes) - sizes
            n, id_n, taken = np.zeros(len(words), np.int64), np.zeros(subwords.size + 1, np.int64), {}
            for d, name, out in zip(docs, names, held_out, strict=True):
                if out:
                    continue
                np.add.at(n, d, 1)
                id_n[subwords.end] += 1
                line = line_of(np.append(ids[_spread(first[d], sizes[d])], subwords.end))
                chunks = range(0, len(line) - SPAN - 1, CHUNK * SPAN)
                marks = _mixed(np.uint64(name) + np.arange(len(chunks), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                for k, to in zip(chunks, (marks % np.uint64(shards * rounds)).tolist(), strict=True):
                    taken.setdefault(to, []).append(line[k : k + SPAN + 1 + CHUNK * SPAN])
            id_n[: subwords.size] = np.bincount(ids, weights=np.repeat(n, sizes), minlength=subwords.size).astype(np.int64)
            yield _rows(len(docs), block=[block] * len(docs), doc_id=rows["doc_id"].combine_chunks(), held_out=held_out, codes=[pack(d) for d in docs])
            yield _rows(1, block=[block], ids=[zstandard.compress(ids.astype("<u2").tobytes(), 1)], id_sizes=[pack(sizes)])
            for a in range(0, len(words), 1 << 16):
                b = min(a + (1 << 16), len(words))
                yield _rows(b - a, block=np.full(b - a, block), word=words[a:b], code=np.arange(a, b), n=n[a:b])
            at = np.flatnonzero(id_n)
            yield _rows(len(at), id=at, id_n=id_n[at])
            for to, parts in taken.items():
                lines = zstandard.compress(np.concatenate(parts).tobytes(), 1)
                yield _rows(1, shard=[to % shards], round=[to // shards], lines=[lines], line_sizes=[pack(np.array([len(p) for p in parts]))])

    return work


def _lines(lines, sizes) -> list[np.ndarray]:
    """All lines of a shard's round in the order of their bytes, so that no task order plays a part."""
    every = []
    for blob, size in zip(lines, sizes, strict=True):
        raw, ends = zstandard.decompress(blob, 1 << 40), 2 * np.cumsum(unpack(size))
        every += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return [np.frombuffer(x, "<u2") for x in sorted(every)]


def _windows(lines, sizes) -> np.ndarray:
    """The windows that ``train`` learns from in these lines, one by one."""
    return np.concatenate([np.lib.stride_tricks.sliding_window_view(x, 2 * SPAN + 1)[::SPAN] for x in _lines(lines, sizes)])


def _contexts(leaf: np.ndarray, inputs: np.ndarray):
    """What stands before which leaf in the windows: counts by context * LEAVES + leaf, once a task."""

    def work(batches):
        total = np.zeros((CONTEXTS + 1) * LEAVES, np.int64)
        for batch in batches:
            for blob, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, n = np.frombuffer(zstandard.decompress(blob, 1 << 40), "<u2").astype(np.int64), unpack(size)
                own = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) > SPAN
                at = np.flatnonzero(own & (ids != PAD_ID))
                total += np.bincount(np.minimum(inputs[ids[at - 1]], CONTEXTS) * LEAVES + leaf[ids[at]], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])

    return work


def _train_shard(weights, rounds: int, at: int, passes: int):
    def work(key, rows):
        blob, vocabulary, cls, place = weights.value
        lines = _lines(rows["lines"].to_pylist(), rows["line_sizes"].to_pylist())
        p = train(from_blob(blob), lines, vocabulary, cls, place, rounds, at, passes)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(len(x) // SPAN - 1 for x in lines)], pa.int64()), "weights": pa.array([to_blob(p)], pa.binary())})

    return work


def _average(key, rows):
    """Mean of the weights of FAN_IN shards at most, by their windows, in the order of the shards."""
    rows = rows.sort_by("shard")
    n = rows["n"].to_pylist()
    total = sum(np.frombuffer(b, _F).astype(np.float64) * k for b, k in zip(rows["weights"].to_pylist(), n, strict=True)) / sum(n)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(n)], pa.int64()), "weights": pa.array([total.astype(_F).tobytes()], pa.binary())})


_SHARD = "shard long, n long, weights binary"


def fit(held: DataFrame, size: int, shards: int, scratch: Scratch):
    """(weights, vocabulary, classes, places) from the written blocks; ``size``: ids, the end included."""
    spark = held.sparkSession
    counts = np.zeros(size, np.int64)
    for r in held.filter("id is not null").groupBy("id").agg(F.sum("id_n").alias("n")).toLocalIterator():  # a row an id of the tokenizer at most
        counts[r.id] = r.n
    vocabulary = Vocabulary(counts)
    lines = held.filter("shard is not null").select("shard", "round", "lines", "line_sizes")
    contexts = np.zeros((CONTEXTS + 1) * LEAVES)
    cells = lines.select("lines", "line_sizes").mapInArrow(_contexts(vocabulary.leaf, vocabulary.inputs), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for batch in cells.toArrow().to_batches():  # one fixed table of 257 x 1,024 cells
        contexts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    contexts = contexts.reshape(CONTEXTS + 1, LEAVES).T
    cls, place = classes(contexts)
    p = fresh(vocabulary, cls, place)
    seen = int(contexts.sum()) // SPAN
    passes = min(MOST_PASSES, max(1, SEEN // max(seen, 1)))
    for at in range(ROUNDS if seen else 0):
        weights = spark.sparkContext.broadcast((to_blob(p), vocabulary, cls, place))
        trained = scratch.cut(lines.filter(F.col("round") == at).groupBy("shard").applyInArrow(_train_shard(weights, ROUNDS, at, passes), _SHARD), f"round-{at}-0")
        left, k = shards, 0
        while left > 1:
            k += 1
            trained = scratch.cut(trained.withColumn("to", F.floor(F.col("shard") / FAN_IN).cast("long")).groupBy("to").applyInArrow(_average, _SHARD), f"round-{at}-{k}")
            left = -(-left // FAN_IN)
        if row := trained.head():  # a small corpus can have a round without windows
            p = from_blob(row.weights)
        weights.unpersist()
    return p, vocabulary, cls, place


def _score_blocks(model, train_tokens: int, distinct: int, train_docs: int, chunk: int = 1 << 18):
    """The documents of a block against the corpus counts of its words and the model."""

    def work(key, rows, counts):
        scorer = Scorer(*model.value)
        known = rows["ids"].is_valid()
        d = rows.filter(known)
        ids, sizes = np.frombuffer(zstandard.decompress(d["ids"][0].as_py(), 1 << 40), "<u2").astype(np.int64), unpack(d["id_sizes"][0].as_py())
        first, end = np.cumsum(sizes) - sizes, len(scorer.vocabulary.leaf) - 1
        docs = rows.filter(rows["codes"].is_valid())
        c = np.zeros(len(sizes), np.int64)
        c[counts["code"].to_numpy()] = counts["c"].to_numpy()
        bottom = train_tokens + 0.1 * (distinct + 1)
        by_word, by_end = np.log10((c + 0.1) / bottom), math.log10((train_docs + 0.1) / bottom)
        n_tokens, n_known, base, score, parts, lengths = [], [], [], [], [], []
        for blob in docs["codes"].to_pylist():
            words = unpack(blob)
            n_tokens.append(len(words) + 1)
            n_known.append(int((c[words] > 0).sum()) + (train_docs > 0))
            base.append(float(by_word[words].sum()) + by_end)
            parts.append(np.append(ids[_spread(first[words], sizes[words])], end))
            lengths.append(len(parts[-1]))
            if sum(lengths) >= chunk:
                score += scorer.scores(np.concatenate(parts), np.array(lengths)).tolist()
                parts, lengths = [], []
        if parts:
            score += scorer.scores(np.concatenate(parts), np.array(lengths)).tolist()
        out = docs.select(["doc_id", "held_out"])
        for name, values, kind in (("n_tokens", n_tokens, pa.int64()), ("n_known", n_known, pa.int64()), ("train_tokens", [train_tokens] * len(score), pa.int64()), ("base_score", base, pa.float64()), ("score", score, pa.float64())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return work


def score(docs: DataFrame, bpe_file: str = BPE_FILE, limit: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    A null text counts as empty: its one token is the end.  Rows that repeat a doc_id are
    documents of their own; a row with a null doc_id is not held out.  Without training
    texts counts are zero and the model is its first weights.  An empty table gives no rows;
    further columns are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    with open(bpe_file, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    size = loaded(file).size + 1
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, round(total / shard_bytes))
    held = scratch.cut(rows.mapInArrow(_read_blocks(file, limit, shards, ROUNDS), ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS)), "blocks")
    model = spark.sparkContext.broadcast(fit(held, size, shards, scratch))

    # A word holds one row a block, whatever its occurrences.
    by_word = Window.partitionBy("word")
    words = held.filter("word is not null").select("block", "code", F.sum("n").over(by_word).alias("c"), (F.min("block").over(by_word) == F.col("block")).alias("first"))
    words = scratch.cut(words.select(F.col("block").alias("of_block"), "code", "c", "first"), "words")
    distinct = words.filter("first and c > 0").count()
    train_docs = held.filter("codes is not null and not held_out").count()
    train_tokens = (held.agg(F.sum("n")).head()[0] or 0) + train_docs
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = held.filter("codes is not null or ids is not null").select("block", "doc_id", "held_out", "codes", "ids", "id_sizes")
    return texts.groupBy("block").cogroup(words.groupBy("of_block")).applyInArrow(_score_blocks(model, train_tokens, distinct + (train_docs > 0), train_docs), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
