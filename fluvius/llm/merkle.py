"""Merkle manifest of a dataset: subroots by source, one root, and a proof for every row.

Rows are put in order by a range sort and numbered by prefix sums over its partitions.  A
tree of fanout 16 is cut into aligned blocks of 16^3 nodes: a task holds one block as a
contiguous matrix of 64-byte hex digests, reshapes it level by level to one row a run and
hashes the rows.  The nodes that blocks leave form the next, 4,096 times smaller table,
until each tree has one node.  Downwards, each node's path (the digests of its run and its
place in it, level by level) is carried from the top table to the next one; rows themselves
meet the path of their block only, and find their siblings by index arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

FANOUT = 16
LEVELS = 3
#: Leaves of one aligned block.
BLOCK = FANOUT**LEVELS
HEX = 64
#: Rows whose crc32 of doc_id is a multiple of this are tampered with.
TAMPER = 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<run:binary,place:int>>"


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column) -> Column:
    """SHA-256 of the row's fields, with ``text`` in the place of the text."""
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in COLUMNS]).cast("binary"), 256)


def ordered(rows: DataFrame, tree: str, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... within ``tree`` by ``order``) and ``total`` (rows of the tree).

    One range sort by (tree, order); a row's place is its place in its partition and the
    rows of the tree in the partitions before.  No tree is gathered in one task.
    """

    def number(batches):
        last, n = None, 0
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), []
            for k in keys:
                if k != last:
                    last, n = k, 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    by = [F.col(tree), *order]
    rest = [c for c in rows.columns if c != tree]
    rows = rows.select(tree, *rest).repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = scratch.cut(rows.mapInArrow(number, f"{kinds}, at long").withColumn("part", F.spark_partition_id()), name)
    parts = rows.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(tree).alias("t_"), F.col("part").alias("p_"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(tree)).alias("total"))
    return rows.join(parts, (F.col(tree) == F.col("t_")) & (F.col("part") == F.col("p_"))).select(tree, *rest, (F.col("at") + F.col("before")).alias("pos"), "total")


def _hash(data) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def levels(leaves: list[bytes], more: int) -> list[np.ndarray]:
    """The digest matrices of a block: leaves, and at most ``more`` levels above until one row is left.

    ``more`` is how many levels the whole tree still has.
    """
    out = [np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, HEX)]
    for _ in range(min(more, LEVELS)):
        below, n = out[-1], len(out[-1])
        whole = n // FANOUT
        rows = below[: whole * FANOUT].reshape(whole, FANOUT * HEX)
        up = [_hash(r) for r in rows]
        if whole * FANOUT < n:
            up.append(_hash(below[whole * FANOUT :].tobytes()))
        out.append(np.frombuffer(b"".join(up), np.uint8).reshape(-1, HEX))
    return out


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    h = 0
    while total > 1:
        total, h = -(-total // FANOUT), h + 1
    return h


def run_of(level: np.ndarray, k: int) -> bytes:
    """The digests of the run that holds node ``k`` of a level."""
    a = k // FANOUT * FANOUT
    return level[a : a + FANOUT].tobytes()


def siblings(level: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``own`` of a level: rows of 15 sibling digests, left to right, and how many of them exist."""
    first, place = own // FANOUT * FANOUT, own % FANOUT
    k = np.arange(FANOUT - 1)
    index = first[:, None] + k + (k >= place[:, None])
    held = np.minimum(len(level) - first, FANOUT) - 1
    return level[np.minimum(index, len(level) - 1)].reshape(len(own), -1), held


def fold(digest: bytes, run: bytes, place: int) -> bytes:
    """The parent's digest, with ``digest`` in its place of the run."""
    return _hash(run[: place * HEX] + digest + run[(place + 1) * HEX :])


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by("pos")


def _up(key, t):
    """The node that a block leaves to the next table."""
    t = _sorted(t)
    total = t["total"][0].as_py()
    top = levels(t["digest"].to_pylist(), height(total))[-1]
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([-(-total // BLOCK)], pa.int64()), "digest": pa.array([top.tobytes()], pa.binary())})


def _node_paths(key, nodes, above):
    """The paths of a block's nodes: their runs here, then the path of the block."""
    nodes = _sorted(nodes)
    total, path, root = nodes["total"][0].as_py(), above["path"][0].as_py(), above["top"][0].as_py()
    mats = levels(nodes["digest"].to_pylist(), height(total))
    paths = []
    for k in range(len(nodes)):
        own, at = [], k
        for level in mats[:-1]:
            own.append({"run": run_of(level, at), "place": at % FANOUT})
            at //= FANOUT
        paths.append(own + path)
    kind = pa.list_(pa.struct([("run", pa.binary()), ("place", pa.int32())]))
    return pa.table({"tree": nodes["tree"], "pos": nodes["pos"], "path": pa.array(paths, kind), "top": pa.array([root] * len(paths), pa.binary())})


def _blocked(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("tree", "block")


def climb(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables of nodes (tree, pos, total, digest), each of the tops of the blocks of the one before, until every tree has one node."""
    tables = [leaves]
    while tables[-1].filter("total > 1").limit(1).count():
        up = _blocked(tables[-1]).applyInArrow(_up, "tree string, pos long, total long, digest binary")
        tables.append(scratch.cut(up, f"{name}-{len(tables)}"))
    return tables


def paths(tables: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Paths (tree, pos, path, top) of the nodes of the second table; ``tops``: those of the single nodes of the last one."""
    found = tops
    for k in range(len(tables) - 2, 0, -1):
        above = found.select("tree", F.col("pos").alias("block"), "path", "top")
        found = scratch.cut(_blocked(tables[k]).cogroup(above.groupBy("tree", "block")).applyInArrow(_node_paths, f"tree string, pos long, path {_PATH}, top binary"), f"{name}-path-{k}")
    return found


def _prove(key, rows, above):
    """Proof, folded root and verdict of each leaf of a block."""
    rows = _sorted(rows)
    total, path, root, subroot = rows["total"][0].as_py(), above["path"][0].as_py(), above["root"][0].as_py(), above["top"][0].as_py()
    leaves, changed = rows["digest"].to_pylist(), rows["tampered"].to_pylist()
    mats = levels(leaves, height(total))[:-1]
    n = len(leaves)
    own, parts = np.arange(n), []
    for level in mats:
        parts.append((*siblings(level, own), level, own))
        own = own // FANOUT
    above_proof = b"".join(s["run"][: s["place"] * HEX] + s["run"][(s["place"] + 1) * HEX :] for s in path)
    proofs, folded = [], []
    for k in range(n):
        h = hashlib.sha256()
        node = changed[k] or leaves[k]
        for rows_, held, level, at in parts:
            h.update(rows_[k, : held[k] * HEX])
            node = fold(node, run_of(level, at[k]), int(at[k] % FANOUT))
        h.update(above_proof)
        for s in path:
            node = fold(node, s["run"], s["place"])
        proofs.append(h.hexdigest())
        folded.append(node.decode())
    fixed = lambda v: pa.array([v.decode()] * n, pa.string())
    return pa.table(
        {
            "doc_id": rows["doc_id"], "leaf": pa.array([x.decode() for x in leaves]), "subroot": fixed(subroot), "root": fixed(root), "proof_sha256": pa.array(proofs),
            "folded_root": pa.array(folded), "verified": pa.array([f.encode() == root for f in folded]),
        }
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Leaves of a source ascend by doc_id, nulls first; rows that share one ascend by their
    leaf, so repeated rows have equal leaves side by side and each its own proof.  A null
    source is a source of its own, first of all.  Null fields are ``-``, empty texts
    ``0:``.  A row with a null doc_id is not tampered with.  An empty table gives no rows;
    further columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    rows = docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).cast("binary").alias("digest"), F.when(picked, leaf(ascii_lower(F.col("text"))).cast("binary")).alias("tampered"),
    )
    leaves = ordered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], scratch, "leaves")
    leaves = scratch.cut(leaves, "ordered")
    tables = climb(leaves.select("tree", "pos", "total", "digest"), scratch, "source")
    if len(tables) == 1:
        tables.append(tables[0])  # every source is a lone leaf: its own top
    subroots = tables[-1].select(F.lit("").alias("all"), "tree", "digest")
    subroots = scratch.cut(ordered(subroots.withColumnRenamed("all", "t"), "t", [F.col("tree")], scratch, "subroots"), "subroots-ordered")
    upper = climb(subroots.select(F.col("t").alias("tree"), "pos", "total", "digest"), scratch, "root")
    none = F.array().cast(_PATH)
    tops = paths([upper[0], *upper], upper[-1].select("tree", "pos", none.alias("path"), F.col("digest").alias("top")), scratch, "root")
    # The path of a subroot, and the root as its top; the source's own tree hangs below it.
    under = subroots.join(tops.drop("tree"), "pos").select("tree", F.lit(0).cast("long").alias("pos"), F.col("path").alias("to_root"), F.col("top").alias("root"), F.col("digest").alias("subroot"))
    start = under.select("tree", "pos", none.alias("path"), F.col("subroot").alias("top"))
    blocks = paths(tables, start, scratch, "source")
    above = blocks.join(under.drop("pos", "subroot"), "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "to_root").alias("path"), "top", "root")
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocked(leaves).cogroup(above.groupBy("tree", "block")).applyInArrow(_prove, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format("{t}" if c == "text" else c) for c in COLUMNS) + ")"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
_STEP = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: {_STEP}), 4294967295)"

SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format(t='text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_LEAF.format(t=_LOW)} END AS bad FROM documents),
o AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM d),
low AS (SELECT tree, 0 AS lv, pos, leaf AS h FROM o
  UNION ALL SELECT tree, lv + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, lv, pos // 16),
subs AS (SELECT tree, max(lv) AS top, arg_max(h, lv) AS h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low GROUP BY tree),
up AS (SELECT 0 AS lv, pos, h FROM subs
  UNION ALL SELECT lv + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM up) WHERE n > 1 GROUP BY lv, pos // 16),
top AS (SELECT arg_max(h, lv) AS root, max(lv) AS high FROM up),
own AS (SELECT o.r, o.tree, k.lv, o.pos // CAST(pow(16, k.lv) AS BIGINT) AS at FROM o JOIN subs USING (tree) JOIN (SELECT DISTINCT lv FROM low) k ON k.lv < subs.top),
own_up AS (SELECT o.r, subs.top + k.lv AS lv, k.lv AS up_lv, subs.pos // CAST(pow(16, k.lv) AS BIGINT) AS at FROM o JOIN subs USING (tree) JOIN (SELECT DISTINCT up.lv FROM up, top WHERE up.lv < top.high) k ON true),
sib AS (SELECT w.r, w.lv, l.pos < w.at AS left_, l.pos, l.h FROM own w JOIN low l ON l.tree = w.tree AND l.lv = w.lv AND l.pos // 16 = w.at // 16 AND l.pos <> w.at
  UNION ALL SELECT w.r, w.lv, u.pos < w.at, u.pos, u.h FROM own_up w JOIN up u ON u.lv = w.up_lv AND u.pos // 16 = w.at // 16 AND u.pos <> w.at),
proof AS (SELECT r, sha256(string_agg(h, '' ORDER BY lv, pos)) AS p FROM sib GROUP BY r),
steps AS (SELECT r, lv FROM own UNION ALL SELECT r, lv FROM own_up),
sides AS (SELECT s.r, s.lv, coalesce(string_agg(h, '' ORDER BY pos) FILTER (left_), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT left_), '') AS g FROM steps s LEFT JOIN sib USING (r, lv) GROUP BY s.r, s.lv),
folds AS (SELECT r, 0 AS lv, coalesce(bad, leaf) AS h FROM o UNION ALL SELECT f.r, f.lv + 1, sha256(l || h || g) FROM folds f JOIN sides s ON s.r = f.r AND s.lv = f.lv),
folded AS (SELECT r, arg_max(h, lv) AS h FROM folds GROUP BY r)
SELECT o.doc_id, o.leaf, subs.h AS subroot, top.root, coalesce(p, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = top.root AS verified
FROM o JOIN subs USING (tree) JOIN folded USING (r) LEFT JOIN proof USING (r), top
"""
