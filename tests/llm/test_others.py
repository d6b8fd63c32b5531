import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluvius.llm import line_dedup as L
from fluvius.llm import pii as P
from fluvius.llm import token_counts as T
from fluvius.llm.common import Scratch

from .edge import documents, texts

TOK = {T.WORDS: None, T.BPE: T.BPE_FILE}


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, text string")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_rollup_follows_inserts_revisions_and_deletes(spark):
    rollup, enc = T.Rollup(spark), T.encoding(T.BPE_FILE)
    n = lambda t: len(enc.encode_ordinary(t))
    assert rollup.apply("a", changes(spark, [("insert", 1, "s", "en", "one two three"), ("insert", 2, "s", "en", "four"), ("insert", 3, None, "de", None)]), TOK)
    first = totals(rollup)
    assert first["s", "en", T.WORDS] == (2, 4) and first["s", "en", T.BPE] == (2, n("one two three") + n("four")) and first[None, "de", T.WORDS] == (1, 0)
    assert not rollup.apply("a", changes(spark, [("insert", 9, "s", "en", "again")]), TOK)
    assert totals(rollup) == first
    rollup.apply("b", changes(spark, [("revise", 1, "t", "en", "now five words are here"), ("delete", 2, None, None, None), ("delete", 77, None, None, None)]), TOK)
    assert totals(rollup) == {("t", "en", T.WORDS): (1, 5), ("t", "en", T.BPE): (1, n("now five words are here")), (None, "de", T.WORDS): (1, 0), (None, "de", T.BPE): (1, 0)}
    assert sorted(rollup.committed()) == ["a", "b"]


def test_query_counts_the_whole_table(spark):
    """Against tokens counted text by text, without batches."""
    import re

    sf, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for name, n in ((T.WORDS, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), (T.BPE, len(T.encoding(T.BPE_FILE).encode_ordinary(r.text or "")))):
            docs, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = docs + 1, tokens + n
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in T.query(spark, sf).collect()} == want


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    monkeypatch.setattr(T, "PART", 50)
    text = " ".join(t or "" for _, t in texts())[:20000]
    assert "".join(T.parts(text)) == text and len(T.parts(text)) > 100
    assert T.count_tokens(text) == len(T.encoding(T.BPE_FILE).encode_ordinary(text))


def test_counts_of_edge_rows(spark):
    d = documents(spark)
    rollup = T.Rollup(spark)
    rollup.apply("x", d.withColumn("op", F.lit("insert")), {T.WORDS: None})
    assert sum(v[0] for v in totals(rollup).values()) == len(texts())
    empty = T.Rollup(spark)
    assert empty.totals().count() == 0
    empty.apply("x", d.limit(0).withColumn("op", F.lit("insert")), {T.WORDS: None})
    assert empty.totals().count() == 0


def test_patience_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 14))] for _ in range(2))
        m = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(i < k and j < l for (i, j), (k, l) in zip(m, m[1:]))
    x = list(range(1, 30))
    assert L.patience(x, x) == [(i, i) for i in range(29)]
    assert L.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]


def test_line_dedup_deletes_from_later_documents(spark):
    rows = {(r.doc_id, r.kept): r for r in L.line_dedup(documents(spark)).collect()}
    by_id = {k[0]: v for k, v in rows.items() if k[0] is not None}
    assert by_id[0].n_removed == 0 and by_id[1].n_removed == 1 and by_id[1].kept == ""
    assert by_id[17].n_removed == 0 and by_id[18].kept == "zero\nfourth" and by_id[18].n_lines == 4
    assert by_id[5].kept == by_id[6].kept == ""
    assert L.line_dedup(documents(spark).limit(0)).count() == 0


def test_long_frequent_lines_are_deleted_between_differing_neighbours(spark):
    line = "this sentence is a licence line that all the documents hold"
    d = spark.createDataFrame([(k, f"own start {k}\n{line}\nown end {k}") for k in range(60)], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.line_dedup(d).collect()}
    assert rows[0].n_removed == 0 and all(rows[k].kept == f"own start {k}\nown end {k}" for k in range(1, 60))


@pytest.mark.parametrize("n", [3, 50, 51, 52, 120])
def test_moved_blocks_go_however_many_hold_them(spark, n):
    x, y = ([f"{name} line {k} of a block that is long enough" for k in range(3)] for name in ("first", "second"))
    d = spark.createDataFrame([(0, "\n".join([*x, "between 0", *y])), *((k, "\n".join([*y, f"between {k}", *x])) for k in range(1, n))], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.line_dedup(d).collect()}
    assert rows[0].n_removed == 0 and all(rows[k].n_removed == 6 and rows[k].kept == f"between {k}" for k in range(1, n))


def runs_in_common(early, late, sizes):
    """Lines of ``late`` in a run of 30 characters and more that stands in ``early`` as well, by comparing all places."""
    out = set()
    for i in range(len(early)):
        for j in range(len(late)):
            k = 0
            while i + k < len(early) and j + k < len(late) and early[i + k] == late[j + k]:
                k += 1
            if sum(sizes[j : j + k]) >= L.MIN_CHARS:
                out.update(range(j, j + k))
    return out


def all_pairs(rows):
    """What is left of each text where each pair is aligned, in order and then by each run of lines alone."""
    part = [L.split_lines(t) for _, t in rows]
    out = []
    for k, (_, _, h, size) in enumerate(part):
        gone = set()
        for early in {tuple(part[e][2]) for e in range(k)}:
            gone |= set(L.common_blocks(list(early), h, size, L.MIN_CHARS)) | runs_in_common(early, h, size)
        out.append(L.delete_lines(rows[k][1], sorted(gone), False))
    return out


def test_line_dedup_equals_alignment_of_all_pairs(spark):
    x, y = "the first line that is shared, long enough", "the second line that is shared, long enough"
    order = [(1, f"{x}\nA\n{y}"), (2, f"{y}\nB\n{x}"), (3, f"{y}\n\nC\n{x}\n")]
    s = [f"short part no {k}" for k in range(3)]
    short = [(11, f"{s[0]}\n{s[1]}\nD"), (12, f"{s[1]}\n{s[2]}\nE"), (13, f"F\n{s[0]}\n{s[1]}\n{s[2]}"), (14, f"{s[0]}\n\n{s[1]}\n{s[2]}\nG")]
    r = random.Random(3)
    mixed = [(k, "\n".join(f"line {w} " + "abcdefgh" * (w % 5) for w in r.choices(range(-4, 40), k=r.randint(2, 9)))) for k in range(20, 80)]
    mixed = [(k, t.replace("line -4 ", "  ")) for k, t in mixed] + [(90 + k, mixed[k][1]) for k in range(4)]
    many = [(k, "\n".join([f"own {k}", "passage of two", "lines that is in all of them", f"end {k}"])) for k in range(100, 112)] + [(120, "lines that is in all of them\nx\npassage of two\nlines that is in all of them\ny\n" * 2)]
    rows = order + short + mixed + many + [(200, "x" * 70_000), (201, "y\n" + "x" * 70_000), (202, ""), (203, "\n\n"), (204, "ab\ncd"), (205, "ab\ncd")]
    got = {v.doc_id: tuple(v[1:]) for v in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for (k, _), want in zip(rows, all_pairs(rows)):
        assert got[k] == want, k
    assert any(v[1] for v in got.values())


def test_rows_that_share_an_identifier_keep_their_own_lines(spark):
    shared, other = "a line that both of them share, long enough", "a line of its own, and long enough as well"
    rows = [(1, shared), (2, shared), (2, other), (None, other), (None, shared + "\n" + other), (None, "a line that nobody else has, long enough")]
    got = Counter((r.doc_id, r.kept) for r in L.line_dedup(spark.createDataFrame([(*x, 5, "k") for x in rows], "doc_id long, text string, early long, key string")).collect())
    assert got == Counter([(1, shared), (2, ""), (2, other), (None, ""), (None, ""), (None, "a line that nobody else has, long enough")])


PII = [
    (1, "Mail Ana.Diaz@corp.example.org or ana.diaz@corp.example.org, call +1 (017) 555-7713 or +1 017 555 7713."),
    (2, "Frau Schmidt met Mr Jones and Mr. Jones; Госпожа Петрова was there. Card 4111 1111 1111 1111, 4111111111111111."),
    (3, 'ip 97.51.17.173 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'),
    (4, None), (5, ""), (6, "nothing here 123"), (None, "x 97.51.17.173"), (7, "a@b.co"), (7, "c@d.co"),
]


def test_surrogates_keep_type_format_and_coreference(spark):
    d = spark.createDataFrame([(*r, "s", 1) for r in PII], "doc_id long, text string, surrogate string, kind int")
    rows = P.pseudonymise(d, "k1").collect()
    out = {r.doc_id: r for r in rows if r.doc_id not in (7, None)}
    a = out[1].text
    mails = [w.strip(".,") for w in a.split() if "@" in w]
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and mails[1].endswith(".org") and "ana" not in a.lower()
    phones = a.split("call ")[1].rstrip(".").split(" or ")
    digits = ["".join(c for c in p if c.isdigit()) for p in phones]
    assert digits[0] == digits[1] and phones[0][:4] == "+1 (" and "0175557713" not in digits[0]
    b = out[2].text
    assert b.count("Mr") == 2 and "Jones" not in b and "Schmidt" not in b and "Петрова" not in b
    name = b.split("Mr ")[1].split(" ")[0]
    assert f"Mr. {name}" in b and b.startswith("Frau ") and b.split()[1].endswith("na") and not name.endswith("a")
    cards = b.split("Card ")[1].rstrip(".").split(", ")
    assert cards[0].replace(" ", "") == cards[1] and len(cards[1]) == 16
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(cards[1])))
    assert total % 10 == 0
    ip = out[3].text.split()[1]
    assert ip.count(".") == 3 and ip != "97.51.17.173" and any(r.text == f"x {ip}" for r in rows if r.doc_id is None)
    assert out[4].text is None and out[5].text == "" and out[6].text == PII[5][1] and out[6].n_entities == 0
    assert len(rows) == len(PII)
    assert sorted(map(str, rows)) == sorted(map(str, P.pseudonymise(d, "k1").collect()))
    assert out[3].text != {r.doc_id: r.text for r in P.pseudonymise(d, "k2").collect()}[3]
    assert P.pseudonymise(d.limit(0), "k").count() == 0


def test_collisions_are_drawn_again(spark):
    names = [(f"name_{'mf'[k % 2]}", f"N{k}") for k in range(400)] + [("ipv4", f"10.0.{k // 250}.{k % 250}") for k in range(500)]
    e = spark.createDataFrame(names, "kind string, entity string")
    rows = P.mapping(e, "k", Scratch(spark, "t")).collect()
    assert len({(r.kind, r.surrogate) for r in rows}) == len(rows) == 900
    assert not {(r.kind, r.surrogate) for r in rows} & set(names)
