import hashlib
import re
from collections import defaultdict

import pytest

from fluvius.llm import exact_dedup as E

from .edge import documents, texts


def by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key_bytes", [32, 1])
def test_equals_grouping_by_text_even_where_digests_collide(spark, key_bytes):
    got = sorted(map(tuple, E.exact_dedup(documents(spark), key_bytes=key_bytes).collect()), key=repr)
    assert got == by_hand(texts())


def test_keep_first_leaves_one_row_a_text_and_all_columns(spark):
    d = documents(spark)
    out = E.keep_first(d)
    assert out.columns == d.columns
    assert out.count() == len({x[4] for x in by_hand(texts())})


def test_batches_compact_to_smallest_identifiers(spark):
    d = documents(spark).filter("doc_id is not null")
    index = E.DigestIndex(spark)
    index.flush(d.filter("doc_id >= 9"), "b")
    index.compact()
    index.flush(d.filter("doc_id < 9"), "a")
    index.flush(d.filter("doc_id < 9"), "a")
    level = {bytes(r.key): r.keep_id for r in index.compact().collect()}
    want = {bytes.fromhex(x[4]): x[1] for x in by_hand([t for t in texts() if t[0] is not None])}
    assert level == want
    some = next(iter(want))
    assert [r.keep_id for r in index.lookup([some, b"no"]).collect()] == [want[some]]


def test_empty_table(spark):
    assert E.exact_dedup(documents(spark).limit(0)).count() == 0
