"""WARC: a writer of one gzip member per record and a sequential reader.

The reader decompresses members incrementally, frames records by Content-Length and
checks each payload against its digest.  Archives lie in a shared folder; a task
writes under a name of its attempt and renames, so a task that runs again replaces
its archives whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
ID = "urn:fluvius:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """A record that breaks the format or does not match its digest."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Members:
    """The decompressed bytes of a stream of gzip members, asked for in pieces."""

    def __init__(self, stream):
        self.stream, self.z, self.buffer, self.raw, self.open = stream, zlib.decompressobj(31), bytearray(), b"", False

    def more(self) -> bool:
        raw = self.raw or self.stream.read(CHUNK)
        if not raw:
            if self.open:
                raise WarcError("the last gzip member is cut off")
            return False
        self.open = True
        self.buffer += self.z.decompress(raw, CHUNK)
        if self.z.eof:
            self.raw, self.z, self.open = self.z.unused_data, zlib.decompressobj(31), False
        else:
            self.raw = self.z.unconsumed_tail
        return True

    def line_block(self) -> bytes | None:
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 3)
            if not self.more():
                if self.buffer:
                    raise WarcError("a header is cut off")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 4]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("a block is cut off")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            if part:
                yield part


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """Records of an open archive, in order; memory holds one record at most, or one piece without payloads."""
    src = _Members(stream)
    while (head := src.line_block()) is not None:
        first, *rest = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError(f"not a record: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        n = int(fields["content-length"])
        block, inner, seen, body = hashlib.sha1(), hashlib.sha1(), 0, []
        lead: bytes | None = b""
        for part in src.pieces(n):
            block.update(part)
            if lead is not None:
                lead += part
                cut = lead.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                part, lead = lead[cut + 4 :], None
            inner.update(part)
            seen += len(part)
            if with_payload:
                body.append(part)
        if b"".join(src.pieces(4)) != b"\r\n\r\n":
            raise WarcError("a record does not end where its length says")
        named = fields.get("warc-block-digest", "").removeprefix("sha1:")
        if named and named != base64.b32encode(block.digest()).decode():
            raise WarcError(f"block digest of {fields.get('warc-record-id')}")
        kind = fields["warc-type"]
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and stated and stated != base64.b32encode(inner.digest()).decode():
            raise WarcError(f"payload digest of {fields.get('warc-record-id')}")
        number = lambda x: None if not x or x.endswith("null>") else int(x.removeprefix(f"<{ID}").rstrip(">"))
        yield {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": seen if kind == "response" else None, "payload_digest": stated, "payload": b"".join(body) if with_payload and kind == "response" else None}


def _writer(folder: str, limit: int):
    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        k, out, size, n, temp = 0, None, 0, 0, ""

        def close():
            out.close()
            final = f"part-{task.partitionId():06d}-{k:04d}.warc.gz"
            store.move(temp, f"{base}/{final}")
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{final}"], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    temp = f"{base}/.attempt-{task.taskAttemptId()}-{k}"
                    out, size, n = store.open_output_stream(temp), 0, 0
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py())
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= limit:
                    yield close()
                    k, out = k + 1, None
        if out is not None:
            yield close()

    return write


def _reader(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches):
        from pyarrow import fs

        rows, held = [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(at)
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        rows.append(r)
                        held += len(r["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """A lazy table of (archive, n_records, n_bytes); materialise it once.

    Of pages with equal payloads of at least ``min_bytes`` bytes the largest page_id is
    a response and the others are revisits; smaller payloads are all responses.  A null
    body is an empty payload.  A null page_id never is the response of a group that has
    another id.  Rows that repeat the response's page_id and payload are responses too.
    """
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    keyed = pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("n"))
    groups = keyed.filter(F.col("n") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) & F.col("first").isNotNull())
    revisits = keyed.join(groups, "key").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("r_id"), F.col("key").alias("r_key"), F.col("first").alias("refers_to")).distinct()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.sha2("payload", 256) == F.col("r_key")), "left")
    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(_writer(folder, archive_bytes), "archive string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in ``manifest`` (a materialised table)."""
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(_reader(with_payload), RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A revisit takes its payload size from the response that it refers to."""
    full = records.filter(F.col("record_type") == "response").select(F.col("page_id").alias("full_id"), F.col("payload_digest").alias("full_digest"), F.col("payload_bytes").alias("full_bytes"))
    wanted = records.filter(F.col("record_type") == "revisit").select(F.col("refers_to").alias("full_id"), F.col("payload_digest").alias("full_digest")).distinct()
    full = full.join(wanted, ["full_id", "full_digest"], "left_semi").dropDuplicates(["full_id", "full_digest"])
    out = records.join(full, (F.col("refers_to") == F.col("full_id")) & (F.col("payload_digest") == F.col("full_digest")), "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_id", "full_digest", "full_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = scratch.cut(write_archives(table(spark, sf_dir, "pages"), scratch.path("archives")), "manifest")
    records = scratch.cut(read_archives(manifest, with_payload=False).drop("payload", "url"), "records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B32 = " || ".join(f"substr('{_CHARS}', CAST(((CAST(('0x' || substr(h, {5 * i + 1}, 5)) AS BIGINT) >> {s}) & 31) AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT body, max(page_id) AS first FROM p GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN p.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = g.first THEN NULL ELSE g.first END AS refers_to
FROM p JOIN g ON p.body = g.body
"""
