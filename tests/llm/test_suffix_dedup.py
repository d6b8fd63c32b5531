import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvius.llm import suffix_dedup as S

from .edge import documents, texts


def by_hand(rows, n=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 1])
def test_equals_brute_force(spark, hot):
    got = sorted(map(tuple, S.dedup_spans(documents(spark), hot=hot).collect()), key=repr)
    assert got == by_hand(texts())


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    rows = [(k, t) for k, t in enumerate(t for _, t in texts() if t)]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]})
    seen = Counter()
    for out in S._occurrences([batch]):
        for doc, start, more in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), out.column(4).to_pylist()):
            for k in range(start, start + (more & 255)):
                seen[doc, k] += 1
    want = Counter((k, a) for k, t in rows for a in range(len(t.encode()) - 199))
    assert seen == want


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_difference_cover_order_is_the_suffix_array(x):
    assert S.difference_cover_order(np.array(x, np.int64), 10**6).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@given(st.lists(st.integers(0, 1), min_size=4, max_size=200), st.integers(2, 9))
@settings(max_examples=200, deadline=None)
def test_bounded_depth_keeps_equal_prefixes_together(x, depth):
    order = S.difference_cover_order(np.array(x, np.int64), depth)
    assert sorted(order.tolist()) == list(range(len(x)))
    full = [tuple(x[i : i + depth]) for i in order if i + depth <= len(x)]
    starts = [k for k, p in enumerate(full) if k == 0 or full[k - 1] != p]
    assert len({full[k] for k in starts}) == len(starts)


def test_empty_table_and_text_out(spark):
    d = documents(spark)
    assert S.dedup_spans(d.limit(0)).count() == 0
    for r in S.dedup_spans(d, with_text=True).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed
