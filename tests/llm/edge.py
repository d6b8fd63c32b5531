"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n double, key string, label int, near_id long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def texts():
    base = words(1, 160)
    near = base.split()
    near[80] = "changed"
    far = base.split()
    for i in range(0, 160, 8):
        far[i] = f"other{i}"
    passage = words(2, 60)
    return [
        (0, base), (1, base), (2, base.replace(" ", "  ", 3)), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "one two"), (10, "One  TWO"),
        (11, words(3, 40) + " " + passage + " " + words(4, 30)), (12, passage + " " + words(5, 20)), (13, words(6, 9000)), (14, "x" * 700), (15, "x" * 100 + "y" + "x" * 250), (16, "ñandú émigré " * 40),
        (17, "line one is here and long enough\nline two also long enough here\nthird"), (18, "zero\nline one is here and long enough\nline two also long enough here\nfourth"), (3, " ".join(near)), (None, base), (None, words(7, 30)), (19, "\x00\x01 tail " * 30),
    ]


def documents(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", None if t is None else len(t), "clash", 0.5, "k", 1, 7) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
