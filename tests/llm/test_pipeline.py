"""The pipeline against plain Python: every stage but the model's, and the rows that every stage must take."""

import itertools
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from fluvius.llm import mixing, quality

from .edge import documents

SF = "/root/testdata/sf0.001"
GAPS = r"[\x20\x09-\x0D]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rank(row):
    return (row[0] is None, row[0] or 0)


def without_copies(rows):
    best = {}
    for r in sorted(rows, key=rank):
        best.setdefault(re.sub(GAPS, " ", r[1] or ""), r)
    return list(best.values())


def without_near_copies(rows):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(GAPS, lowered(text)) if x]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    kept = {}
    for k in sorted(range(len(rows)), key=lambda k: rank(rows[k])):
        kept.setdefault(find(k), rows[k])
    return list(kept.values())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def without_hits(rows, items):
    windows = set()
    for text in items:
        w = words(text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return Counter(rows)


@pytest.fixture
def edge_dir(spark, tmp_path):
    bench = [(1, "ñandú émigré ñandú"), (2, None), (3, ""), (4, "no such passage in any of these documents at all you see")]
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = plain(quality.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert 0 < len(at) < docs.count()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at = without_hits(without_near_copies(without_copies(at)), items)
    kept = docs.join(spark.createDataFrame([(i,) for i, _ in at], "doc_id long"), "doc_id")
    want = Counter({r.doc_id: r.copies for r in mixing.rates(kept).filter("copies > 0").collect()})
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == want
    plan = {r.source: (r.target, r.n) for r in mixing.rates(kept).groupBy("source", "target").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    taken = Counter()
    for r in mixing.rates(kept).collect():
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - target) <= 0.25 * target for s, (target, n) in plan.items() if n >= 20)


def test_stages_on_awkward_rows(spark, edge_dir):
    """Nulls, empty and long texts, ties, repeats, and columns that operators use inside."""
    stages = dict(P.STAGES)
    docs = documents(spark)
    rows = plain(docs)
    assert counted(plain(stages["exact_dedup"](spark, docs, edge_dir))) == counted(without_copies(rows))
    near = stages["near_dedup"](spark, docs, edge_dir)
    texts = [r for r in rows if re.sub(GAPS, "", r[1] or "")]
    assert counted(r for r in plain(near) if r in texts) == counted(without_near_copies(texts))
    assert counted(r for r in plain(near) if r not in texts) == counted(r for r in rows if r not in texts)
    items = [r.text for r in spark.read.parquet(f"{edge_dir}/benchmark.parquet").collect()]
    clean = without_hits(rows, items)
    assert len(clean) < len(rows)
    assert counted(plain(stages["decontaminate"](spark, docs, edge_dir))) == counted(clean)
    good = counted(plain(stages["quality"](spark, docs, edge_dir)))
    assert not good - counted(rows)
    mixed = stages["mix"](spark, docs, edge_dir)
    assert mixed.columns == docs.columns + ["copy_no"]
    assert set(plain(mixed)) <= set(rows)
    P.run(spark, edge_dir).collect()


def test_stages_on_empty_tables(spark, edge_dir, tmp_path):
    none = documents(spark).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, edge_dir).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    rows = plain(documents(spark))
    assert counted(plain(dict(P.STAGES)["decontaminate"](spark, documents(spark), f"{tmp_path}/none"))) == counted(rows)
    assert not counted(plain(dict(P.STAGES)["quality"](spark, documents(spark), f"{tmp_path}/none"))) - counted(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
