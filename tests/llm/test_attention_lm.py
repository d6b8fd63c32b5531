"""The base against plain counts; the model against attention token by token, its gradient, its total mass and held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fluvius.llm import attention_lm as M

from .edge import documents, texts

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text)."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not out_of(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = [*words(t), None]
        out.append((i, out_of(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def columns(df):
    return df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[5])


def same(found, want):
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert tuple(f[:5]) == w[:5] and f[5] == pytest.approx(w[5], abs=1e-6)
        assert math.isfinite(f[6]) and f[6] < 0


def test_query_base_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(columns(M.query(spark, SF)), plain(rows))


def test_awkward_rows_whatever_the_blocks(spark):
    found = columns(M.score(documents(spark)))
    same(found, plain(texts()))
    small = columns(M.score(documents(spark).repartition(5), limit=2000))
    same(small, plain(texts()))
    for a, b in zip(sorted(found, key=key), sorted(small, key=key), strict=True):
        assert a.score == pytest.approx(b.score, rel=1e-3)


def test_no_rows_and_no_training_rows(spark):
    assert columns(M.score(documents(spark).filter("false"))) == []
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, ["a b", None, "", "c"], strict=True)], "doc_id long, text string")
    same(columns(M.score(docs)), plain([(r.doc_id, r.text) for r in docs.collect()]))


def small_model(seed=3, ids=1500):
    r = np.random.default_rng(seed)
    vocabulary = M.Vocabulary(r.integers(0, 50, ids))
    cls, place = M.classes(r.integers(0, 9, (M.LEAVES, M.CONTEXTS + 1)).astype(float))
    p = M.fresh(vocabulary, cls, place, seed)
    p["key"][:, : M.LEAVES, -1] = r.normal(0, 0.5, (M.HEADS, M.LEAVES))
    return p, vocabulary, cls, place


def distribution(model, before):
    """Log probabilities of all ids after the ids ``before``, by attention over one position at a time."""
    p, vocabulary, cls, place = model
    inputs = [M.BOS, *vocabulary.leaf[np.array(before, int)].tolist()]
    at = len(before)
    first = max(0, at // M.SPAN * M.SPAN - M.SPAN)
    hidden = p["skip"][inputs[at]].astype(float)
    for h in range(M.HEADS):
        q = p["query"][h][inputs[at]].astype(float)
        logit = np.array([q @ p["key"][h][inputs[j]] + p["far"][h][at - j] for j in range(first, at + 1)])
        a = np.exp(logit - logit.max())
        hidden[h * M.HEAD : (h + 1) * M.HEAD] += (a / a.sum()) @ np.array([p["value"][h][inputs[j]] for j in range(first, at + 1)])
    hidden = np.maximum(hidden, 0)
    log = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    to_class, leaves = log(hidden @ p["to_class"] + p["class_bias"]), np.empty(M.LEAVES)
    for leaf in range(M.LEAVES):
        leaves[leaf] = to_class[cls[leaf]] + log(hidden @ p["to_place"][cls[leaf]] + p["place_bias"][cls[leaf]])[place[leaf]]
    return leaves[vocabulary.leaf] + vocabulary.inner


@pytest.mark.parametrize("times", [1, 30])
def test_scores_equal_attention_token_by_token(times):
    """Also with logits far beyond what exponentials hold."""
    model, r = small_model(), np.random.default_rng(1)
    for name in ("query", "to_class", "to_place"):
        model[0][name][..., : M.HEAD - 1] *= times
    docs = [r.integers(0, 1500, n) for n in (1, 2, 15, 16, 17, 50)]
    got = M.Scorer(*model).scores(np.concatenate(docs), np.array([len(d) for d in docs]))
    for d, g in zip(docs, got, strict=True):
        want = sum(distribution(model, d[:k])[d[k]] for k in range(len(d))) / math.log(10)
        assert g == pytest.approx(want, rel=1e-4)


def test_all_ids_have_probability_one_together():
    assert np.exp(distribution(small_model(), [4, 900, 17])).sum() == pytest.approx(1, abs=1e-4)


def test_windows_hold_every_token_once_as_a_target():
    tokens = np.arange(100, 151)
    w = M.windows_of(tokens)
    targets = w[:, M.SPAN + 1 :].ravel()
    assert targets[targets != M.PAD_ID].tolist() == tokens.tolist()
    assert w[0, M.SPAN] == M.BOS_ID and w[1, 0] == M.BOS_ID and w[2, : M.SPAN + 1].tolist() == tokens[15:32].tolist()


def test_gradient_by_differences():
    p, vocabulary, cls, place = small_model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    tokens = np.random.default_rng(2).integers(0, 1500, 70)
    w = M.windows_of(tokens)
    x, ids = vocabulary.inputs[w[:, : 2 * M.SPAN]], w[:, M.SPAN + 1 :]
    y = np.where(ids == M.PAD_ID, -1, vocabulary.leaf[np.minimum(ids, 1499)])
    loss = lambda: -M.gradient(p, x, y, cls, place)[0].astype(float).mean()
    _, g = M.gradient(p, x, y, cls, place)
    seen = int(vocabulary.leaf[tokens[5]])
    spots = {"skip": (seen, 3), "query": (0, seen, 2), "key": (1, seen, 4), "value": (0, seen, 1), "far": (1, 2), "to_class": (5, int(cls[seen])), "class_bias": (3,), "to_place": (int(cls[seen]), 7, int(place[seen])), "place_bias": (int(cls[seen]), 1)}
    for name, at in spots.items():
        held, step = p[name][at], 1e-4
        p[name][at] = held + step
        up = loss()
        p[name][at] = held - step
        down = loss()
        p[name][at] = held
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8), name


def test_slope_over_whole_lines_is_that_over_their_windows():
    """Texts of one batch stand one after the other; none sees another, and keys of a span count once for each span that sees them."""
    p, vocabulary, cls, place = small_model()
    p, r = {k: v.astype(np.float64) for k, v in p.items()}, np.random.default_rng(4)
    docs = [r.integers(0, 1500, n) for n in (1, 16, 17, 300, 40)]
    lines = [x[k : k + M.SPAN + 1 + 4 * M.SPAN] for x in map(M.line_of, docs) for k in range(0, len(x) - M.SPAN - 1, 4 * M.SPAN)]
    ll, g = M.slope(p, *M.spans_of(lines, vocabulary), cls, place)
    w = np.concatenate([M.windows_of(d) for d in docs])
    ids = w[:, M.SPAN + 1 :]
    y = np.where(ids == M.PAD_ID, -1, vocabulary.leaf[np.minimum(ids, 1499)])
    want_ll, want = M.gradient(p, vocabulary.inputs[w[:, : 2 * M.SPAN]], y, cls, place)
    assert len(ll) == sum(map(len, docs)) and np.sort(ll) == pytest.approx(np.sort(want_ll), rel=1e-9)
    for name, a in M.views(g).items():
        assert a == pytest.approx(want[name], rel=1e-6, abs=1e-12), name


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = [r for r in columns(M.query(spark, "/root/testdata/sf0.01")) if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_words_are_encoded_each_by_itself():
    s = M.Subwords(open(M.BPE_FILE, "rb").read())
    some = ["hello", "it's", "日本", "a　b", "\x1cx", "...", "ñandú", "x" * 3000]
    for group in (some, some[:3], [w for w in some if not any(c.isspace() for c in w)]):
        ids, sizes = s.encode([w.encode() for w in group])
        want = [s.code.encode_ordinary(" " + w) for w in group]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_every_window_of_the_training_texts_is_learned_from_once(spark):
    """Long texts, repeated ones and small ones: what all shards of all rounds are given is what plain windows are."""
    rows = [(i, " ".join(f"w{i * 7 % 5}{k * k % 97}" for k in range(n))) for i, n in enumerate([0, 1, 15, 16, 17, 700, 2500, 40, 40, 3, 1023, 90])]
    rows += [(7, rows[7][1])] * 2
    s = M.Subwords(open(M.BPE_FILE, "rb").read())
    encoded = lambda t: [x for w in t.lower().split() for x in s.code.encode_ordinary(" " + w)] + [s.end]
    want = Counter(tuple(w) for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in M.windows_of(np.array(encoded(t))).tolist())
    scratch = M.Scratch(spark, "lm-test")
    seen = Counter()
    file = spark.sparkContext.broadcast(open(M.BPE_FILE, "rb").read())
    docs = spark.createDataFrame([(i, zlib.crc32(str(i).encode()) % 10 == 0, t.encode()) for i, t in rows], "doc_id long, held_out boolean, text binary").repartition(3)
    held = scratch.cut(docs.mapInArrow(M._read_blocks(file, 5000, 3, M.ROUNDS), ", ".join(f"{name} {kind}" for name, kind, _ in M._FIELDS)), "blocks")
    pieces = held.filter("shard is not null").groupBy("shard", "round").agg({"lines": "collect_list", "line_sizes": "collect_list"}).collect()
    assert len(pieces) > 3 and {r["round"] for r in pieces} <= set(range(M.ROUNDS)) and {r["shard"] for r in pieces} <= {0, 1, 2}
    for r in pieces:
        seen.update(map(tuple, M._windows(r["collect_list(lines)"], r["collect_list(line_sizes)"]).tolist()))
    assert seen == want
