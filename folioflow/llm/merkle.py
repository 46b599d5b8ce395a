"""Merkle dataset manifest: a tree of sha256 digests over the rows of every language, and one over the languages' roots.

Leaves are hashed by Spark's own functions. Rows get their places in their language by a range partitioning and the counts of its parts, so no language
is ever in one task. Each aligned block of ``BLOCK`` places is a contiguous numpy matrix of 64-byte hexadecimal digests, which is reshaped by the fanout
and hashed level by level; the siblings of a place are found by index arithmetic in the kept levels. The roots of blocks are the leaves of the next
tree of blocks, until a language has one block; the siblings above a block travel down once a block, not once a row.

Defined results: a null field is ``-``; null doc_ids come first, rows of one doc_id are ordered by their leaf, so equal rows have neighbouring places and
equal leaves; a table of one row has its leaf as root and the digest of nothing as proof; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: A block has as many places as the largest power of the fanout up to this.
BLOCK = 4096
_PATH = "array<struct<left:binary,right:binary>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields (hexadecimal): each is its length in bytes, a colon and its text, or ``-``."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def placed(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """``nodes`` with ``place`` (from 0) in their ``group`` by ``order``, and ``size``, the number of rows of the group. Groups have no nulls."""
    n = common.n_shuffle(nodes.sparkSession)
    row = common.free_name(nodes, "row")
    t = common.written(nodes.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn(row, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(row, 33)
    # A row for each part of each group: as many as parts and groups together.
    parts = t.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min(row).alias("_first"), F.count("*").alias("_n"))
    each = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("size"))
    both = t.join(parts, (F.col(group) == F.col("_g")) & (part == F.col("_part")))
    return both.select(*nodes.columns, (F.col(row) + F.col("_shift")).alias("place"), "size")


def _hashed(rows: np.ndarray) -> np.ndarray:
    """The digests of the rows of a matrix of bytes, as rows of 64 hexadecimal signs."""
    data, width = rows.tobytes(), rows.shape[1]
    return np.frombuffer(b"".join([hashlib.sha256(data[i : i + width]).hexdigest().encode() for i in range(0, len(data), width)]), np.uint8).reshape(-1, 64)


def levels(nodes: np.ndarray, fanout: int, height: int | None) -> list[np.ndarray]:
    """The matrices of all levels, the given one first: ``height`` of them above it, or as many as it takes to one node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        last = out[-1]
        whole = len(last) // fanout * fanout
        up = _hashed(last[:whole].reshape(-1, 64 * fanout))
        out.append(np.concatenate([up, _hashed(last[whole:].reshape(1, -1))]) if whole < len(last) else up)
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> list[list[tuple[bytes, bytes]]]:
    """For each node of the lowest level: the digests left and right of it in its run, level by level up to the last."""
    n = len(tree[0])
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in range(n)]
    at = np.arange(n)
    for level in tree[:-1]:
        data = level.tobytes()
        first = at // fanout * fanout
        last = np.minimum(first + fanout, len(level))
        for path, a, i, b in zip(out, (64 * first).tolist(), (64 * at).tolist(), (64 * last).tolist(), strict=True):
            path.append((data[a:i], data[i + 64 : b]))
        at = at // fanout
    return out


def folded(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and the siblings on its way up give."""
    for left, right in path:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


def _block(fanout: int) -> tuple[int, int]:
    """Places of a block and its height."""
    height = 1
    while fanout ** (height + 1) <= BLOCK:
        height += 1
    return fanout**height, height


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, 64)


def _tree(t: pa.Table, fanout: int, width: int, height: int) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of a block in order, and its levels; a group's only block goes up to one node."""
    t = t.sort_by("place")
    return t, levels(_matrix(t, "digest"), fanout, height if t["size"][0].as_py() > width else None)


def _roots(fanout: int):
    width, height = _block(fanout)

    def run(t: pa.Table) -> pa.Table:
        t, tree = _tree(t, fanout, width, height)
        size = t["size"][0].as_py()
        return pa.table([t["grp"][:1], pa.array([t["place"][0].as_py() // width]), pa.array([-(-size // width)]), pa.array([tree[-1].tobytes().decode()])], names=["grp", "place", "size", "digest"])

    return run


def _path_column(paths: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind)


def _path(value: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(x["left"], x["right"]) for x in value]


def _paths(fanout: int):
    width, height = _block(fanout)

    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        t, tree = _tree(t, fanout, width, height)
        rest, root = (_path(above["path"][0].as_py()), above["root"][0].as_py()) if len(above) else ([], tree[-1].tobytes().decode())
        return pa.table([t["grp"], t["place"], _path_column([p + rest for p in siblings(tree, fanout)]), pa.array([root] * len(t))], names=["grp", "place", "path", "root"])

    return run


def _with_block(nodes: DataFrame, fanout: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / _block(fanout)[0]).cast("long"))


def block_roots(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """grp, place, size and digest of the blocks of ``nodes`` (grp, place, size, digest)."""
    return common.written(_with_block(nodes.select("grp", "place", "size", "digest"), fanout).groupBy("grp", "block").applyInArrow(_roots(fanout), "grp string, place long, size long, digest string"), "roots")


def climb(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """grp, place, path (the digests left and right, level by level) and root of every node of ``nodes``. A round for each ``BLOCK`` times fewer nodes."""
    width, _ = _block(fanout)
    steps = [nodes]
    while (steps[-1].agg(F.max("size")).first()[0] or 0) > width:
        steps.append(block_roots(steps[-1], fanout))
    above = nodes.sparkSession.createDataFrame([], f"grp string, place long, path {_PATH}, root string")
    for step in reversed(steps):
        low, high = _with_block(step.select("grp", "place", "size", "digest"), fanout), above.withColumnRenamed("place", "block")
        above = common.written(low.groupBy("grp", "block").cogroup(high.groupBy("grp", "block")).applyInArrow(_paths(fanout), f"grp string, place long, path {_PATH}, root string"), "paths")
    return above


def _finish(fanout: int):
    width, height = _block(fanout)

    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        t, tree = _tree(t, fanout, width, height)
        rest, subroot, root = _path(above["path"][0].as_py()), above["subroot"][0].as_py(), above["root"][0].as_py()
        end = b"".join([a + b for a, b in rest])
        proofs, folds = [], []
        for path, digest in zip(siblings(tree, fanout), t["claimed"].to_pylist(), strict=True):
            proofs.append(hashlib.sha256(b"".join([a + b for a, b in path]) + end).hexdigest())
            folds.append(folded(digest.encode(), path + rest).decode())
        n = len(t)
        same = pa.array([f == root for f in folds])
        return pa.table([t["doc_id"], t["digest"], pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds), same], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of ``rows`` (grp: text that orders the groups, doc_id, digest: the leaf, claimed: the
    leaf as someone has it now). A leaf is verified if it and the siblings recorded for its place lead to the root."""
    leaves = placed(rows.select("grp", "doc_id", "digest", "claimed"), "grp", "doc_id", "digest")
    blocks = climb(block_roots(leaves, fanout), fanout)
    subroots = blocks.groupBy("grp").agg(F.first("root").alias("digest"))
    tops = common.written(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "grp", "of"), "subroots")
    upper = climb(tops, fanout).select("place", F.col("path").alias("rest"), F.col("root").alias("top"))
    upper = tops.select("of", F.col("digest").alias("subroot"), "place").join(upper, "place").select("of", "subroot", "rest", "top")
    above = blocks.join(upper, F.col("grp") == F.col("of")).select(F.col("of"), F.col("place").alias("block"), F.concat("path", "rest").alias("path"), "subroot", F.col("top").alias("root"))
    low = _with_block(leaves, fanout)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return low.groupBy("grp", "block").cogroup(above.groupBy("of", "block")).applyInArrow(_finish(fanout), schema)


def tampered(doc_id: Column) -> Column:
    """Whether the test of the manifest changes a row: 7 divides the crc32 of its id in decimals; rows without an id stay."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    claimed = leaf([*(fields | {"n_chars": F.when(tampered(F.col("doc_id")), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).values()])
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return manifest(common.written(docs.select(group.alias("grp"), "doc_id", leaf([*fields.values()]).alias("digest"), claimed.alias("claimed")), "leaves"))


#: The same rows in SQL: the remainders of crc32 for single bytes by rule, levels by recursion, and the way up of each leaf by joins with its neighbours.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(b)),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits),
rows AS (SELECT *, coalesce('=' || lang, '') AS g, crc % 7 = 0 AS changed FROM (SELECT d.*,
  xor(list_reduce(list_prepend(4294967295, [unicode(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM documents d, tab)),
fields AS (SELECT g, doc_id, coalesce(changed, false) AS changed, n_chars,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM rows),
hashed AS (SELECT g, doc_id, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN changed THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
tree AS (
  SELECT g, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, i // 2, n),
subs AS (SELECT g, d, level, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, d FROM subs
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
nodes AS (
  SELECT t.g, t.level, t.i, t.d, t.n FROM tree t WHERE t.n > 1
  UNION ALL
  SELECT s.g, s.level + p.level, p.i, p.d, p.n FROM subs s, top p WHERE p.n > 1),
start AS (SELECT l.g, l.doc_id, l.leaf, l.other, l.i, s.d AS subroot, s.i AS place, s.level AS height, (SELECT d FROM top WHERE n = 1) AS root FROM leaves l JOIN subs s USING (g)),
way AS (
  SELECT g, doc_id, leaf, i AS id, subroot, root, place, height, 0 AS level, CASE WHEN height = 0 THEN place ELSE i END AS i, '' AS proof, coalesce(other, leaf) AS f FROM start
  UNION ALL
  SELECT w.g, w.doc_id, w.leaf, w.id, w.subroot, w.root, w.place, w.height, w.level + 1, CASE WHEN w.level + 1 = w.height THEN w.place ELSE w.i // 2 END,
    w.proof || coalesce(b.d, ''), sha256(CASE WHEN w.i % 2 = 0 THEN w.f || coalesce(b.d, '') ELSE b.d || w.f END)
  FROM way w JOIN nodes a ON a.g = w.g AND a.level = w.level AND a.i = w.i LEFT JOIN nodes b ON b.g = w.g AND b.level = w.level AND b.i = xor(w.i, 1)),
ends AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY level DESC) AS k FROM way)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM ends WHERE k = 1
"""
