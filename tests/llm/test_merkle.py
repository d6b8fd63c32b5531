"""The manifest against a tree made node by node."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from fluvius.llm import merkle as M

from .edge import documents

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [*row[:4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def low(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> the contract's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree(sorted_leaves(by[s])[1]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        rows_, _ = sorted_leaves(by[s])
        for i, r in enumerate(rows_):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof, path = leaf(r, low(r[4]) if bad else r[4]), [], [(lv, i // 16**n) for n, lv in enumerate(trees[s][:-1])] + [(lv, k // 16**n) for n, lv in enumerate(top[:-1])]
            for level, at in path:
                a = at // 16 * 16
                left, right = level[a:at], level[at + 1 : a + 16]
                proof += left + right
                node = h(*left, node, *right)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def sorted_leaves(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    return rows, [leaf(r, r[4]) for r in rows]


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def plain(df):
    return [tuple(r) for r in df.select(*M.COLUMNS[:1], "source", "lang", "n_chars", "text").collect()]


def test_awkward_rows(spark):
    docs = documents(spark)
    assert got(M.manifest(docs)) == brute(plain(docs))


def test_parts_of_the_rows(spark):
    docs = documents(spark)
    assert got(M.manifest(docs.filter("false"))) == []
    for some in (docs.filter("doc_id = 4"), docs.filter("source = 'src1'"), docs.filter("source is null or doc_id = 4")):
        assert got(M.manifest(some)) == brute(plain(some))


@pytest.mark.parametrize("sources", [1, 700])
def test_trees_of_several_tables(spark, sources):
    """More leaves, and more subroots, than a block holds."""
    n = M.BLOCK + 700 if sources == 1 else 900
    rows = spark.range(n).selectExpr("id * 3 % 100003 as doc_id", f"concat('s', id % {sources}) as source", "'en' as lang", "id as n_chars", "concat('Text ', id) as text")
    assert got(M.manifest(rows)) == brute(plain(rows))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(M.SQL)
    names = [x[0] for x in found.description]
    assert got(M.query(spark, SF)) == sorted((tuple(r[names.index(c)] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.fetchall()), key=repr)


def test_every_sibling_by_index_arithmetic():
    leaves = [hashlib.sha256(bytes([k])).hexdigest().encode() for k in range(37)]
    level = M.levels(leaves, M.height(37))[0]
    rows, held = M.siblings(level, np.arange(37))
    for k in range(37):
        a = k // 16 * 16
        assert bytes(rows[k, : held[k] * M.HEX]) == b"".join(leaves[a:k] + leaves[k + 1 : a + 16])
