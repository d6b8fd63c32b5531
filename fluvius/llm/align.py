"""Two tokenizers aligned: minimal groups of tokens that cover the same bytes, and their links.

Tokens of A and B are the nodes of a bipartite graph, with an edge where their byte ranges
overlap.  Union-find gives its connected components, which are the minimal groups; members
of a component are linked with one another.  How many documents hold a pair linked is
counted over the corpus by Spark: once a block of texts and distinct pair.

Neither tokenizer joins a space to the visible character before it, so texts are cut there
into segments (a space and what follows).  A segment is encoded and aligned once a block.
Both encoders are checked for this on every chunk; where a token crosses a cut, or the
bytes of the tokens are not those of the text, segments are encoded one by one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, Codes, in_blocks, pack, unpack
from .common import Scratch, table

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of segments that are encoded in one call.
CHUNK = 1 << 18
#: A space after white space belongs to the segment before: A's pattern takes such runs together.
_RUN = re.compile(r"\s ")
_OTHER = re.compile(r"[^\S ]|\s\s|▁|\s\Z")
_B_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their entries, from the contents of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            m = _B_BYTE.fullmatch(piece)
            self.b_bytes.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space+text by A and of text by B; None where their bytes are not space+text."""
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None


_pairs: dict[bytes, Pair] = {}


def loaded(files) -> Pair:
    """The tokenizers of a broadcast pair of files, once a worker."""
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(*files)
    return _pairs[key]


def segments(text: str) -> list[str]:
    """Parts of the text that start after a space which a visible character precedes; that space is left out."""
    parts = text.split(" ")
    if not _RUN.search(" " + text) and parts[-1]:
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if not out[-1] or out[-1][-1].isspace() or out[-1].endswith("▁"):
            out[-1] += " " + p
        else:
            out.append(p)
    if len(out) > 1 and not out[-1]:
        out[-2:] = [out[-2] + " "]
    return out


def components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Union-find over edges (left, right) of ``n`` nodes: each node's root, the least node of its component.

    Roots are hooked onto the least root that an edge shows them, then all paths are halved until none is left.
    """
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and of B, ascending along the text, from the byte offsets where tokens end."""
    cuts = np.union1d(a_ends, b_ends)
    # Between two cuts lies exactly one token of each side: that is an overlap.
    a, b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    root = components(a, len(a_ends) + b, len(a_ends) + len(b_ends))
    _, number = np.unique(root, return_inverse=True)  # the root is the group's first token of A
    return number[: len(a_ends)], number[len(a_ends) :]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def _by_id(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), sorted, with how often each occurs."""
    key, n = np.unique(group.astype(np.int64) << 32 | ids.astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


class Aligned:
    """What a list of texts gives: sizes of each, and its distinct linked id pairs with how often each occurs.

    ``pair_of``, ``key``, ``times`` list the pairs by text; a key is A id * 2^32 + B id.
    """

    def __init__(self, a_ids, b_ids, a_ends, b_ends, text_ends):
        n = len(text_ends)
        ga, gb = groups(a_ends, b_ends)
        a_text, b_text = np.searchsorted(text_ends, a_ends), np.searchsorted(text_ends, b_ends)
        self.n_a, self.n_b = np.bincount(a_text, minlength=n), np.bincount(b_text, minlength=n)
        size_a, size_b = np.bincount(ga), np.bincount(gb)
        text = np.zeros(len(size_a), np.int64)
        text[ga] = a_text
        self.n_groups = np.bincount(text, minlength=n)
        self.n_links = np.bincount(text, weights=size_a * size_b, minlength=n).astype(np.int64)
        # Members expand to links, equal ids of a group once with their number.
        g1, x, m1 = _by_id(ga, a_ids)
        g2, y, m2 = _by_id(gb, b_ids)
        begin = np.searchsorted(g2, np.arange(len(size_a) + 1))
        count = (begin[1:] - begin[:-1])[g1]
        other = _spread(begin[:-1][g1], count)
        self.pair_of, self.key, self.times = np.repeat(text[g1], count), np.repeat(x, count) << 32 | y[other], np.repeat(m1, count) * m2[other]
        sa, sb = np.concatenate(([0], np.cumsum(size_a))), np.concatenate(([0], np.cumsum(size_b)))
        a_str, b_str = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        sa, sb = sa.tolist(), sb.tolist()
        one = ["%s|%s" % (",".join(a_str[sa[k] : sa[k + 1]]), ",".join(b_str[sb[k] : sb[k + 1]])) for k in range(len(size_a))]
        at = np.concatenate(([0], np.cumsum(self.n_groups))).tolist()
        self.strings = [";".join(one[at[k] : at[k + 1]]) for k in range(n)]


def align(pair: Pair, texts: list[str]) -> tuple[Aligned, np.ndarray]:
    """The texts' alignment, and which of them are equal in bytes by both tokenizers; the others have none."""
    a, b, ends, ok, at = [], [], [], np.zeros(len(texts), bool), 0
    joined = None
    if len(texts) > 1 and not _OTHER.search(" ".join(texts)) and all(texts):
        joined = pair.encode(" ".join(texts))
    if joined:
        a_ids, b_ids = np.array(joined[0], np.int64), np.array(joined[1], np.int64)
        a_ends, b_ends = np.cumsum(pair.a_len[a_ids]), np.cumsum(pair.b_len[b_ids])
        text_ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        if np.isin(text_ends, a_ends).all() and np.isin(text_ends, b_ends).all():
            ok[:] = True
            return Aligned(a_ids, b_ids, a_ends, b_ends, text_ends), ok
    for k, t in enumerate(texts):
        if both := pair.encode(t):
            a += both[0]
            b += both[1]
            ok[k], at = True, at + len(t.encode()) + 1
            ends.append(at)
    a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
    return Aligned(a_ids, b_ids, np.cumsum(pair.a_len[a_ids]), np.cumsum(pair.b_len[b_ids]), np.array(ends, np.int64)), ok


class _Dictionary:
    """Alignments of a block's distinct segments, by number."""

    def __init__(self, pair: Pair, units: list[str]):
        n = len(units)
        self.ok = np.zeros(n, bool)
        self.sums = np.zeros((4, n), np.int64)
        self.strings = [""] * n
        owner, key, times = [], [], []
        plain = [k for k, u in enumerate(units) if u and not _OTHER.search(u)]
        rest = [k for k, u in enumerate(units) if not u or _OTHER.search(u)]
        for chosen in (plain, rest):
            chunk, size = [], 0
            for i, k in enumerate(chosen):
                chunk.append(k)
                size += len(units[k]) + 1
                if size < CHUNK and i + 1 < len(chosen):
                    continue
                done, ok = align(pair, [units[j] for j in chunk])
                at = np.array(chunk)[ok]
                self.ok[at] = True
                self.sums[:, at] = done.n_a, done.n_b, done.n_groups, done.n_links
                for j, s in zip(at.tolist(), done.strings, strict=True):
                    self.strings[j] = s
                owner.append(at[done.pair_of])
                key.append(done.key)
                times.append(done.times)
                chunk, size = [], 0
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        owner, key, times = whole(owner), whole(key), whole(times)
        self.keys, code = np.unique(key, return_inverse=True)
        order = np.argsort(owner, kind="stable")
        self.code, self.times = code[order], times[order]
        self.first = np.searchsorted(owner[order], np.arange(n + 1))

    def pairs(self, codes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the segments ``codes``, each occurring ``often``, and how often each pair occurs."""
        count = self.first[codes + 1] - self.first[codes]
        where = _spread(self.first[codes], count)
        code, weight = self.code[where], self.times[where] * np.repeat(often, count)
        order = np.argsort(code, kind="stable")
        code, weight = code[order], weight[order]
        new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        return code[new], np.add.reduceat(weight, new) if len(new) else weight


_DOCS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *_DOCS, ("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary()), ("code", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])
_BLOCKS_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, code int, pair long, docs long"


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _BLOCKS], schema=_BLOCKS)


def _align_blocks(files, limit: int):
    """doc_id, text -> a row a document (with its pairs as numbers of the block) and a row a distinct pair of the block."""

    def work(batches):
        pair = loaded(files.value)
        for block, rows in in_blocks(batches, "text", limit):
            codes, docs = Codes(), []
            for raw in rows["text"].to_pylist():
                if not raw:
                    docs.append(None)
                    continue
                docs.append(codes.get(segments(raw.decode("utf-8", "replace"))))
            known = _Dictionary(pair, list(codes.of))
            held = np.zeros(len(known.keys), np.int64)
            sums, shas, blobs, times = np.zeros((4, len(docs)), np.int64), [], [], []
            for k, d in enumerate(docs):
                if d is None or not known.ok[d].all():
                    shas.append("")
                    blobs.append(None)
                    times.append(None)
                    continue
                sums[:, k] = known.sums[:, d].sum(1)
                shas.append(hashlib.sha256(";".join(map(known.strings.__getitem__, d.tolist())).encode()).hexdigest())
                pairs, often = known.pairs(*np.unique(d, return_counts=True))
                held[pairs] += 1
                blobs.append(pack(np.diff(pairs, prepend=0)))
                times.append(pack(np.minimum(often, 0xFFFFFFFF)))
            yield _rows(len(docs), block=[block] * len(docs), doc_id=rows["doc_id"].combine_chunks(), n_a=sums[0], n_b=sums[1], n_groups=sums[2], n_links=sums[3], groups_sha256=shas, codes=blobs, times=times)
            at = np.flatnonzero(held)  # pairs of documents that have no tokens after all stay out
            for a in range(0, len(at), 1 << 16):
                part = at[a : a + (1 << 16)]
                yield _rows(len(part), block=np.full(len(part), block), code=part, pair=known.keys[part], docs=held[part])

    return work


def _sum_blocks(key, docs, counts):
    """Each document's links against the corpus-wide counts of its block's pairs."""
    code = counts["code"].to_numpy()
    n = int(code.max()) + 1 if len(code) else 0
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    count[code], best[code] = counts["count"].to_numpy(), counts["best"].to_numpy()
    n_best, total = [], []
    for blob, times in zip(docs["codes"].to_pylist(), docs["times"].to_pylist(), strict=True):
        if blob is None:
            n_best.append(0)
            total.append(0)
            continue
        pairs, often = np.cumsum(unpack(blob)), unpack(times)
        n_best.append(int(often[best[pairs]].sum()))
        total.append(int((often * count[pairs]).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def files(spark: SparkSession, a_file: str, b_file: str):
    """Both vocabulary files, read by the driver and broadcast: a few MB, whatever the corpus."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def alignments(docs: DataFrame, scratch: Scratch, a_file: str = A_FILE, b_file: str = B_FILE, limit: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents by block, pairs (a_id, b_id, pair, count, best)): the alignment and the corpus-wide table of linked pairs.

    ``count`` documents hold the pair linked; ``best``: no other pair of this A id is held by more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    held = scratch.cut(rows.mapInArrow(_align_blocks(files(docs.sparkSession, a_file, b_file), limit), _BLOCKS_SQL), "blocks")
    counts = held.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = scratch.cut(counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), (F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("b_id"), "pair", "count"), "counts")
    most = counts.groupBy(F.col("a_id").alias("m_id")).agg(F.max("count").alias("most"))
    return held, counts.join(most, F.col("a_id") == F.col("m_id")).select("a_id", "b_id", "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have
    no tokens: zeros and an empty digest.  Rows that repeat a doc_id, or have none, are
    documents of their own, each counted.  An empty table gives no rows; further columns
    are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "align")
    held, counts = alignments(docs, scratch, a_file, b_file, limit)
    pairs = held.filter(F.col("pair").isNotNull()).select(F.col("block").alias("of_block"), "code", F.col("pair").alias("held_pair"))
    known = pairs.join(counts, F.col("held_pair") == F.col("pair")).select("of_block", "code", "count", "best")
    texts = held.filter(F.col("n_a").isNotNull()).drop("code", "pair", "docs")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_sum_blocks, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
