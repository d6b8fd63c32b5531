"""Tokens of two tokenizers aligned, against whole texts encoded and grouped in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvius.llm import align as M

from .edge import SCHEMA, documents, texts

SF = "/root/testdata/sf0.001"
PAIR = M.Pair(open(M.A_FILE, "rb").read(), open(M.B_FILE, "rb").read())
AWKWARD = [
    "a b", " a", "a ", "a  b", "  ", " ", "a \n b", "\n a\tb  c", "x  y", " ", "a▁b c", "▁", "<|endoftext|> and <s> </s> <unk>", "it's we'll 'tis", "\x00 \x01", "日本語 テキスト 🙂 🙂🙂", "é ́",
    "ﬁne ½ Ⅷ", "a　 b", "a 　b", "\x1c x\x1f y", "<0x41> <0x0A>", "tail\n ", "x" * 5000, "word " * 300, "​​ zero", "ñandú  émigré", "A\r\n B",
]


def plain(text):
    """(a groups, b groups) of a whole text by a walk over byte offsets; None without tokens."""
    both = PAIR.encode(text) if text else None
    if not both:
        return None
    (a, b), out, i, j = both, [], 0, 0
    while i < len(a):
        ga, gb, at, bt = [a[i]], [b[j]], len(PAIR.a_bytes[a[i]]), len(PAIR.b_bytes[b[j]])
        i, j = i + 1, j + 1
        while at != bt:
            if at < bt:
                ga.append(a[i])
                at += len(PAIR.a_bytes[a[i]])
                i += 1
            else:
                gb.append(b[j])
                bt += len(PAIR.b_bytes[b[j]])
                j += 1
        out.append((ga, gb))
    return out


def brute(rows):
    """The contract's rows of (doc_id, text)."""
    found = [(i, plain(t)) for i, t in rows]
    links = [None if g is None else Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, g in found]
    count = Counter(p for c in links if c for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, g), c in zip(found, links, strict=True):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        n = sum(c.values())
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), n, sum(m for p, m in c.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in c.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(M.query(spark, SF)) == brute(rows)


def test_awkward_rows_in_small_blocks(spark):
    rows = texts() + [(100 + k, t) for k, t in enumerate(AWKWARD)]
    more = spark.createDataFrame([(i, t, None, None, None, "c", 0.5, "k", 1, 7) for i, t in rows[len(texts()) :]], SCHEMA)
    want = brute(rows)
    for limit in (1, 300, M.BLOCK_BYTES):
        assert got(M.align_documents(documents(spark).unionByName(more), limit=limit)) == want


def test_empty_table(spark):
    assert got(M.align_documents(documents(spark).filter("false"))) == []


def test_segments_of_any_text_give_what_the_whole_gives():
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "日", "🙂", " ", "\x1d", "12", "...", "Wort", " ", "-", "\x00"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        cut = M.segments(text)
        assert " ".join(cut) == text
        whole, each = PAIR.encode(text), [PAIR.encode(s) for s in cut]
        assert (whole is None) == (None in each), repr(text)
        if whole:
            assert (sum((e[0] for e in each), []), sum((e[1] for e in each), [])) == whole, repr(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_union_find(edges):
    left, right = np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64)
    label = list(range(31))
    for _ in range(31):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert M.components(left, right, 31).tolist() == label


def test_pair_table(spark):
    from fluvius.llm.common import Scratch

    docs = spark.createDataFrame([(1, "wandering wandering"), (2, "wandering"), (3, None)], "doc_id long, text string")
    _, pairs = M.alignments(docs, Scratch(spark, "t"))
    rows = pairs.collect()
    assert rows and all(r["count"] == 2 and r.best and (r.a_id << 32 | r.b_id) == r.pair for r in rows)
