import hashlib
import re

import pytest

from fluvius.llm import decontaminate as D

from .edge import documents, texts, words

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def items(spark):
    passage = words(2, 60).split()
    rows = [(1, " ".join(passage[5:40]).upper()), (2, "ONE, two!"), (3, None), (4, "..."), (5, words(99, 30)), (None, "x"), (6, words(3, 40)[-60:]), (7, "two")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, spans int")


def by_hand(docs, rows):
    windows = {}
    for i, t in rows:
        w = split(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    found |= s
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_equals_brute_force_in_one_pass_or_many(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D, "table", lambda s, d, name: {"documents": documents(s), "benchmark": items(s)[1]}[name])
    got = sorted(map(tuple, D.query(spark, "").collect()), key=repr)
    assert got == by_hand(texts(), items(spark)[0])


def test_clean_keeps_whole_rows(spark):
    d = documents(spark)
    want = [x for x in by_hand(texts(), items(spark)[0]) if not x[5]]
    out = D.clean(d, items(spark)[1])
    assert out.columns == d.columns and out.count() == len(want)


def test_longest_matches(spark):
    rows = D.longest_matches(documents(spark), items(spark)[1]).filter("item_id = '1' and item_pos = 0").collect()
    assert {(r.doc_id, r.n_words) for r in rows} == {(11, 35), (12, 35)}
    assert {r.doc_pos for r in rows} == {45, 5}


def test_empty_tables(spark):
    d, b = documents(spark), items(spark)[1]
    assert D.contaminated_spans(d.limit(0), b).count() == 0
    assert D.contaminated_spans(d, b.limit(0)).filter("size(spans) > 0").count() == 0


def test_equal_windows_are_expanded_once():
    items = D.Items([("a", "go " * 400), ("b", "go " * 30)], 10)
    word = next(iter(items.vocabulary.values()))
    shard = D.Shard([[word] * 20_000], items)
    _, _, _, lo, hi = D.search(shard.a, shard.sa, items)
    lo, hi, window, owners = D.ranges(items, lo, hi)
    assert len(lo) == 1 and hi[0] - lo[0] == 19_991 and window[0] == 10 and sorted(items.ids[i] for i in owners[0]) == ["a", "b"]
