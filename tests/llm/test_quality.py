import numpy as np
from pyspark.sql import functions as F

from fluvius.llm import quality as Q

from .edge import documents, words


def corpus(spark, n=600):
    rows = []
    for i in range(n):
        good = i % 5 != 1
        t = words(i, 30 + i % 50)
        rows.append((i, t if good else " ".join(f"{w}$$$" for w in t.split()), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_held_out_rows_are_told_apart(spark):
    d, labels = corpus(spark)
    rows = {r.doc_id: r for r in Q.classify(d, labels).collect()}
    assert {i for i, r in rows.items() if r.held_out} == {i for i in rows if Q.fold(i) == 0}
    wrong = [i for i, r in rows.items() if r.held_out and r.predicted != int(i % 5 != 1)]
    assert len(wrong) <= 2
    assert Q.keep_good(d, labels).count() == sum(r.predicted for r in rows.values())


def test_held_out_labels_change_nothing(spark):
    d, labels = corpus(spark, 200)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, Q.classify(d, x).collect())) for x in (labels, flipped))
    assert a == b


def test_edge_rows(spark):
    d = documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, None), (4, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    out = Q.classify(d, labels).collect()
    assert len(out) == d.count() and all(0 <= r.score <= 1 for r in out)
    assert Q.classify(d, labels.limit(0)).filter("abs(score - 0.5) > 1e-9").count() == 0
    assert Q.classify(d.limit(0), labels).count() == 0
    assert Q.keep_good(d, labels).columns == d.columns


def test_pairs_are_learned():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
