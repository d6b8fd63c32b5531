import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluvius.llm import jaccard_join as J

from .edge import documents, texts, words

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def by_hand(rows):
    s = sets(rows)
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and 100 * both >= 75 * len(s[a][1] | s[b][1]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(x), (i if not x else min(least[find(k)], default=None))) for k, (i, x) in enumerate(s)), key=repr)


def family(seed, n, groups):
    """Groups of texts that differ from one another by a few words, near the limit and beyond."""
    r, rows, k = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(8, 150))]
        for _ in range(n):
            t = list(base)
            for _ in range(r.randint(0, 9)):
                t[r.randrange(len(t))] = f"m{r.randint(0, 10**6)}"
            rows.append((k, " ".join(t[: r.randint(len(t) - 3, len(t))])))
            k += 1
    return rows


@pytest.mark.parametrize("kw", [{}, {"hot_list": 2, "star": 2}])
def test_edge_rows(spark, kw):
    got = sorted(map(tuple, J.jaccard_components(documents(spark), **kw).collect()), key=repr)
    assert got == by_hand(texts())


def test_many_near_copies(spark):
    rows = family(5, 60, 4)
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), star=8).collect()), key=repr)
    assert got == by_hand(rows)
    assert len(Counter(x[2] for x in got)) > 4


def test_first_prefixes_keep_the_promise():
    """Of similar sets, the first prefixes share as many shingles as each side counts on."""
    r = np.random.default_rng(1)
    levels = r.integers(0, 3, 1 << J.SKETCH_BITS).astype(np.uint8)
    tried = 0
    while tried < 300:
        n = int(r.integers(1, 80))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        for k in r.integers(0, len(a), int(len(a) * 0.12)):
            b[k] = r.integers(0, 1 << 63)
        b = np.unique(b)[: len(b) - int(r.integers(0, 1 + len(b) // 9))]
        if not len(b) or not J.similar(a, b):
            continue
        tried += 1
        (ta, _, ca, la), (tb, _, cb, lb) = J.first_prefix(a, levels), J.first_prefix(b, levels)
        assert len(set(ta[:ca].tolist()) & set(tb.tolist())) >= la
        assert len(set(tb[:cb].tolist()) & set(ta.tolist())) >= lb


def test_identifiers_that_repeat_or_lack(spark):
    """Texts link by themselves: two texts of one identifier, near copies without one, a bridge without one."""
    base = words(1, 160)
    at = lambda *ks: " ".join("changed" if k in ks else w for k, w in enumerate(base.split()))
    other = words(9, 120)
    rows = [(3, base), (3, other), (0, at(80)), (5, other.replace(other.split()[60], "new")), (None, at(10)), (7, at(10, 80)), (None, words(4, 50))]
    bridge = words(12, 100).split()
    rows += [(20, " ".join(bridge)), (None, " ".join(bridge[:84])), (21, " ".join(bridge[:70]))]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == by_hand(rows)
    assert {x[2] for x in got if x[0] in (20, 21)} == {20}
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == sorted([(0, at(80)), (3, other), (20, " ".join(bridge))])
    assert [r.text for r in kept if r.doc_id is None] == [words(4, 50)]


def test_keep_one_and_empty(spark):
    d = documents(spark)
    out = J.keep_one(d)
    want = {x[2] for x in by_hand(texts()) if x[1] and x[2] is not None}
    assert out.columns == d.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(i for i, t in got if i is not None and (t or "").split()) == sorted(want)
    assert len([1 for i, t in got if i is None]) == 1
    assert len([1 for _, t in got if not (t or "").split()]) == len([1 for _, t in texts() if not (t or "").split()])
    assert J.jaccard_components(d.limit(0)).count() == 0 and J.keep_one(d.limit(0)).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_long_words_without_a_common_letter_stay_apart(spark):
    """Words and their complements, which sums of powers of an odd base cannot tell apart."""
    rows, k = [], 0
    for n in (64, 1024, 2048, 4096):
        for letters in ("ab", "ba"):
            rows.append((k, thue_morse(n, letters)))
            rows.append((k + 1, "one two three four " + thue_morse(n, letters) + " five six seven"))
            k += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=repr) == by_hand(rows)
    assert all(r.doc_id == r.component_id for r in J.jaccard_components(df).collect())
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == [i for i, _ in rows]


def test_words_hash_alike_wherever_they_stand():
    r = random.Random(9)
    some = ["".join(r.choice("abABé") for _ in range(r.randint(1, 40))) for _ in range(400)]
    text = " \n".join(some)
    raw = text.encode().lower()
    for half, seed in zip(J._words(raw), (1, 0x51ED270B0A1F39C1), strict=True):
        each = [int(J._word_hashes(np.frombuffer(w.encode().lower(), np.uint8), seed)[0]) for w in some]
        assert half.tolist() == each
        assert len(set(each)) == len({w.encode().lower() for w in some})


def test_links_are_decided_by_both_halves():
    a = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.uint64)
    b = a.copy()
    assert J.similar(a, b)
    b[1, :2] += np.uint64(1)
    assert not J.similar(a, b)


def test_levels_take_little_memory():
    """The driver holds no float arrays of the sketch's length: they took 160 MB and more."""
    import tracemalloc

    r = np.random.default_rng(3)
    counts = r.poisson(3, 1 << J.SKETCH_BITS).astype(np.uint32)
    counts[r.integers(0, len(counts), 500)] += r.integers(1, 100_000, 500).astype(np.uint32)
    excess = counts - counts.mean()
    want = np.where(excess >= 8 * np.sqrt(counts.mean() + 1) + 8, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)
    del excess
    tracemalloc.start()
    got = J._level_of(counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and most < 16 << 20
