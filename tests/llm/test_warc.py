import base64
import hashlib
import io

import pytest

from fluvius.llm import warc as W
from fluvius.llm.common import Scratch


def pages(spark):
    rows = [(k, f"http://a/{k}", h, "x") for k, h in enumerate(["<p>a</p>", "<p>a</p>", "", None, "é" * 9000, "<p>a</p>", "\r\n\r\n--", "b"])]
    rows += [(None, None, "<p>a</p>", "x"), (None, "u", "only null", "x"), (7, "http://a/7", "b", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_round_trip_and_revisits(spark, size):
    scratch = Scratch(spark, "t")
    manifest = scratch.cut(W.write_archives(pages(spark), scratch.path("a"), archive_bytes=size), "m")
    rows = W.resolve_revisits(scratch.cut(W.read_archives(manifest), "r")).collect()
    assert sum(r.n_records for r in manifest.collect()) == len(rows) == 11
    for r in rows:
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
            assert r.payload_bytes == len(r.payload) and r.refers_to is None
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows), key=repr)
    assert kinds == sorted([(0, "revisit", 5, 8), (1, "revisit", 5, 8), (5, "response", None, 8), (2, "revisit", 3, 0), (3, "response", None, 0), (4, "response", None, 18000), (6, "response", None, 6), (7, "response", None, 1), (7, "response", None, 1), (None, "revisit", 5, 8), (None, "response", None, 9)], key=repr)


def test_each_record_is_a_gzip_member_and_damage_is_found():
    a, b = W.record(1, "u", b"x" * 200_000), W.record(2, "v\r\nEvil: 1", b"y")
    got = list(W.read_records(io.BytesIO(a + b)))
    assert [(r["page_id"], len(r["payload"])) for r in got] == [(1, 200_000), (2, 1)]
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO((a + b)[:-9])))
    import gzip

    plain = gzip.decompress(a)
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO(gzip.compress(plain.replace(b"xxx", b"xyx", 1)))))
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO(gzip.compress(plain.replace(b"Content-Length: 2", b"Content-Length: 1", 1)))))


def test_empty_table(spark):
    scratch = Scratch(spark, "t")
    manifest = scratch.cut(W.write_archives(pages(spark).limit(0), scratch.path("a")), "m")
    assert W.read_archives(manifest).count() == 0
