"""Line dedup by pairwise alignment.

A document is its sequence of lines that are not blank, as hashes.  A block is a run of
lines with at least MIN_CHARS characters; the least blocks that begin or end at each line
are a document's anchors, so two documents can lose a common block only if they share an
anchor.  Documents of equal sequences are one class, of which the first row alone is
aligned; the others lose every line.

A document is aligned by patience diff with the first holder of each anchor that it shares.
A diff keeps the order of lines, so blocks that stand in another order there can be left:
each anchor that still has lines is then aligned by itself, as an excerpt of its first
holder.  The rule is the same however many documents hold an anchor, and pairs grow with the
anchors, not with the square of their holders.  Common blocks are deleted from the later
document, the one with the larger doc_id.  Everything is judged on the input, and a blank
line goes with the lines around it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_CHARS = 30
#: Documents aligned beside one copy of a first holder's lines.
PARTNERS = 1024


def line_hash(line: str) -> int:
    """Hash of a line without white space at its ends."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def split_lines(text: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """All lines; place, hash and size of those that are not blank."""
    lines = (text or "").split("\n")
    full = [(k, s) for k, x in enumerate(lines) if (s := x.strip())]
    return lines, [k for k, _ in full], [line_hash(s) for _, s in full], [len(s) for _, s in full]


def least_blocks(sizes: list[int], min_chars: int) -> set[tuple[int, int]]:
    """Half-open runs with ``min_chars`` characters that are the least from their first or to their last line."""
    sums = [0, *accumulate(sizes)]
    from_line = {(a, bisect_left(sums, x + min_chars)) for a, x in enumerate(sums)}
    to_line = {(bisect_right(sums, x - min_chars) - 1, b) for b, x in enumerate(sums) if x >= min_chars}
    return {(a, b) for a, b in from_line | to_line if b < len(sums)}


def anchors(h: list[int], sizes: list[int], min_chars: int) -> dict[int, list[tuple[int, int]]]:
    """Hash of each least block -> the runs where it stands."""
    raw, out = np.array(h, np.int64), {}
    for a, b in least_blocks(sizes, min_chars):
        out.setdefault(xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) - (1 << 63), []).append((a, b))
    return out


def _rows(min_chars: int):
    def work(batches):
        for batch in batches:
            keys, hashes, sizes, grams = [], [], [], []
            for t in batch.column(2).to_pylist():
                _, _, h, size = split_lines(t)
                keys.append(xxhash.xxh3_128_digest(np.array(h, np.int64).tobytes()))
                hashes.append(h)
                sizes.append(size)
                grams.append(sorted(anchors(h, size, min_chars)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(hashes, longs), pa.array(sizes, pa.list_(pa.int32())), pa.array(grams, longs)], ["rid", "doc_id", "key", "h", "size", "grams"])

    return work


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of a patience diff, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {v: j for j, v in enumerate(b[b0:b1], b0) if nb[v] == 1}
        both = [(i, at[v]) for i, v in enumerate(a[a0:a1], a0) if v in at and na[v] == 1]
        tails, last, back = [], [], [None] * len(both)
        for k, (_, j) in enumerate(both):
            p = bisect_left(tails, j)
            back[k] = last[p - 1] if p else None
            tails[p : p + 1], last[p : p + 1] = [j], [k]
        chain, k = [], last[-1] if last else None
        while k is not None:
            chain.append(both[k])
            k = back[k]
        ends = [(a0 - 1, b0 - 1), *reversed(chain), (a1, b1)]
        if len(ends) == 2:
            continue
        out += chain
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(out)


def common_blocks(early: list[int], late: list[int], sizes: list[int], min_chars: int) -> list[int]:
    """Positions in ``late`` of aligned blocks with at least ``min_chars`` characters."""
    out, block, before = [], [], None
    for i, j in [*patience(early, late), (None, None)]:
        if before and (i, j) == (before[0] + 1, before[1] + 1):
            block.append(j)
        else:
            if sum(sizes[x] for x in block) >= min_chars:
                out += block
            block = [j]
        before = (i, j) if i is not None else None
    return out


def _align(min_chars: int):
    def work(batches):
        for batch in batches:
            late, gone = [], []
            for doc, eh, lh, ls in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if lines := common_blocks(eh, lh, ls, min_chars):
                    late.append(doc)
                    gone.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(late, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["late", "gone"])

    return work


def _open(min_chars: int):
    """Anchors that have a line which is not deleted, with the lines where they stand."""

    def work(batches):
        for batch in batches:
            docs, keys, places = [], [], []
            for doc, h, size, gone in zip(*(batch.column(k).to_pylist() for k in range(4))):
                drop = set(gone or ())
                for key, runs in anchors(h, size, min_chars).items():
                    at = sorted({k for a, b in runs for k in range(a, b)})
                    if not drop.issuperset(at):
                        docs.append(doc)
                        keys.append(key)
                        places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["doc", "gram", "at"])

    return work


def delete_lines(text: str | None, gone: list[int] | None, all_gone: bool) -> tuple[int, int, str]:
    """Number of lines, of deleted ones, and the text left; ``gone`` counts lines that are not blank."""
    lines, place, _, _ = split_lines(text)
    drop = set(place) if all_gone else {place[k] for k in gone or ()}
    if drop:
        full, before, after = set(place), set(), set()
        for order, seen in ((range(len(lines)), before), (range(len(lines) - 1, -1, -1), after)):
            goes = True
            for k in order:
                if k in full:
                    goes = k in drop
                elif goes:
                    seen.add(k)
        drop |= before & after  # blank lines between deleted lines, or the text's end
    return len(lines) if text else 0, len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text or ""


def _delete(batches):
    for batch in batches:
        out = [delete_lines(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_lines", "n_removed", "kept"])


def _aligned(pairs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """late, gone: positions in ``late`` of blocks common with any ``early`` of its pairs."""
    load = pairs.groupBy("early").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    heads = load.join(lines, F.col("early") == F.col("doc")).select("early", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("h").alias("early_h"))
    tails = pairs.join(load, "early").join(lines, F.col("late") == F.col("doc")).select("early", F.pmod(F.xxhash64("late"), F.col("parts")).cast("int").alias("part"), "late", "h", "size")
    return tails.join(heads, ["early", "part"]).select("late", "early_h", "h", "size").mapInArrow(_align(min_chars), "late long, gone array<int>")


def _together(gone: DataFrame) -> DataFrame:
    return gone.groupBy("late").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text left) for every row.

    A null or empty text has no lines and stays empty; a document without ``min_chars``
    characters in its lines loses nothing.  Documents are told apart by their lines: of
    equal ones the least doc_id stays (with all rows of that id), nulls last, and rows that
    repeat a doc_id with other texts are documents of their own, ordered by a digest.  An
    empty table gives no rows; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    cut, drop = scratch.cut, scratch.drop
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    rid = F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text)))
    rows = docs.select(rid.alias("rid"), doc_id.alias("doc_id"), text.alias("text"))
    lines = cut(rows.mapInArrow(_rows(min_chars), "rid binary, doc_id long, key binary, h array<long>, size array<int>, grams array<long>"), "lines").filter(F.size("grams") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("r")
    classes = cut(lines.groupBy("key").agg(first, F.count(F.lit(1)).alias("copies")), "classes")
    copies = classes.filter("copies > 1").select(F.col("key").alias("c_key"), F.col("r.doc_id").alias("first_id"))
    whole = lines.select("rid", "doc_id", "key").join(copies, F.col("key") == F.col("c_key")).filter(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("rid").distinct()
    # Numbers that grow with (doc_id, digest), given once as the table is written; the lines themselves are not sorted.
    order = cut(classes.orderBy("r.none", "r.doc_id", "key").select(F.monotonically_increasing_id().alias("doc"), F.col("key").alias("c_key"), F.col("r.rid").alias("c_rid")), "order")
    reps = lines.join(order, (F.col("key") == F.col("c_key")) & (F.col("rid") == F.col("c_rid"))).dropDuplicates(["key", "rid"])
    reps = cut(reps.select("doc", "rid", "h", "size", "grams"), "reps")
    keys = reps.select("doc", F.explode("grams").alias("gram"))
    held = cut(keys.groupBy("gram").agg(F.min("doc").alias("early"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "held")
    pairs = cut(keys.join(held, "gram").filter(F.col("early") < F.col("doc")).select("early", F.col("doc").alias("late")).distinct(), "pairs")
    gone = cut(_together(_aligned(pairs, reps, min_chars)), "gone")
    # What an alignment in order has left of a shared anchor is aligned with that anchor alone.
    later = pairs.select(F.col("late").alias("doc")).distinct()
    left = reps.join(later, "doc", "left_semi").join(gone, F.col("doc") == F.col("late"), "left").select("doc", "h", "size", "gone").mapInArrow(_open(min_chars), "doc long, gram long, at array<int>")
    moved = left.join(held, "gram").filter(F.col("early") < F.col("doc")).select(F.col("doc").alias("late"), F.col("at").alias("gone"))
    gone = _together(gone.unionByName(moved))
    gone = gone.join(reps.select("doc", "rid"), F.col("late") == F.col("doc")).select("rid", "gone", F.lit(False).alias("whole"))
    gone = cut(gone.unionByName(whole.select("rid", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("whole"))), "all-gone")
    drop("order", "pairs", "held")
    out = rows.join(gone.select(F.col("rid").alias("g_rid"), "gone", "whole").hint("merge"), F.col("rid") == F.col("g_rid"), "left")
    out = out.select("doc_id", "text", "gone", F.coalesce("whole", F.lit(False)).alias("whole"))
    return out.mapInArrow(_delete, "doc_id long, n_lines long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
