import pytest
from pyspark.sql import functions as F

from fluvius.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double, copies string"


def by_hand(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    """Share by weight, stop at the ceilings, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        if not open_:
            return fixed
        level = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in open_}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1, "d": 500, "e": 2, None: 7}, {"a": 0, "b": 9}, {"x": 5}, {"a": 1000, "b": 30, "c": 3, "d": 1}])
def test_targets_follow_capping_and_resharing(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    got, want = {r.source: r.target for r in rows}, by_hand(sizes)
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert got[s] == pytest.approx(t)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def docs(spark, n=900):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "en", None if i % 31 == 0 else f"s{min(i % 10, 6)}", 0, 0.5, "x") for i in range(n)]
    rows += [(None, "null id", "en", "s1", 0, 0.5, "x"), (5000, None, "en", "s2", 0, 0.5, "x"), (5001, "  \t\n", None, "s2", None, None, None), (7, rows[7][1], "en", "s6", 0, 0.5, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_taken_words_come_near_their_targets(spark):
    d = docs(spark)
    rows = mixing.rates(d).withColumn("taken", F.col("size") * F.col("copies"))
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert r.over <= 0 and abs(r.taken - r.target) <= max(25, 0.03 * r.target)


def test_mix_repeats_whole_rows_and_reruns_agree(spark):
    d = docs(spark)
    first = sorted(map(tuple, mixing.mix(d).collect()), key=repr)
    assert first == sorted(map(tuple, mixing.mix(d).collect()), key=repr)
    copies = mixing.rates(d).agg(F.sum("copies")).head()[0]
    assert len(first) == copies
    assert mixing.mix(d).columns == [*d.columns, "copy_no"]


def test_empty_table(spark):
    d = docs(spark).limit(0)
    assert mixing.rates(d).count() == 0 and mixing.mix(d).count() == 0
