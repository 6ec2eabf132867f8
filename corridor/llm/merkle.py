"""A Merkle manifest of a dataset: a tree over each source's rows and one over the sources' roots.

``leaves`` hashes rows, ``build`` numbers them within their source and hashes the trees,
``prove`` gives every leaf its siblings up to the root, ``audit`` recomputes the root from a
claimed leaf and those siblings.

Nodes are worked on in aligned blocks of ``FANOUT ** BLOCK_LEVELS``: a task holds a block's
digests as one contiguous matrix of 64-byte hex rows, reads it ``FANOUT`` rows at a time as
one row, hashes those level by level, and takes siblings by index arithmetic. A block's root
is a node of the next round, so a tree of n leaves takes about log(n) / log(4096) rounds, each
4096 times smaller. On the way down a block gets its own siblings above it, once for all its
leaves. Numbers within a source come from sorted ranges and one small row a range and source:
a source of any size is spread over many tasks.

Digests are lowercase hex of sha256; a node hashes its children's hex, in order. Runs are of
``FANOUT`` consecutive nodes, the last of a level of what is left; a lone node is a root.

Defined results: a leaf hashes doc_id, source, lang, n_chars and text, each ``-`` where null,
else its bytes' number, ``:`` and its value; empty and very long texts are whole values.
Null ids come first, rows of equal ids by their leaves; equal rows have leaves of their own. A
null source is a source of its own, before all others. An empty table has no root and gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.session import materialise

FANOUT = 16
BLOCK_LEVELS = 3
BLOCK = FANOUT**BLOCK_LEVELS
HEX = 64
#: For each place in a run, the other places.
_OTHERS = [np.array([[j for j in range(size) if j != i] for i in range(size)], dtype=np.int64).reshape(size, size - 1) for size in range(1, FANOUT + 1)]
#: Whole columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """Nodes by round: ``rows`` are the leaves; ``rounds`` and ``tops`` hold the nodes of the sources' trees and of the tree above."""

    rows: DataFrame
    rounds: list[DataFrame]
    tops: list[DataFrame]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row; ``changed`` are other values of its fields."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None, **changed: Column) -> DataFrame:
    """``doc_id, source, leaf, claimed``: where ``tampered`` holds, the claim is the leaf of the row with the ``changed`` fields."""
    claimed = F.when(tampered, leaf(**changed)) if tampered is not None else F.lit(None).cast("string")
    return docs.select("doc_id", "source", leaf().alias("leaf"), claimed.alias("claimed"))


def _numbered(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``pos``, their place within ``tree`` by ``order``, and ``n``, the tree's rows. Written once, so that places stay as they are."""
    kept = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialise(kept, "merkle-rows").withColumn("_part", F.shiftright("_at", 33))
    stats = kept.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = W.partitionBy("tree")  # one row a range of the source
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stats = stats.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return kept.join(stats, ["tree", "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _n_levels(n: int) -> int:
    """Levels of a tree of ``n`` nodes that one round hashes."""
    levels = 0
    while levels < BLOCK_LEVELS and FANOUT**levels < n:
        levels += 1
    return levels


def _matrices(digests: pa.ChunkedArray, n: int) -> list[np.ndarray]:
    """The block's digests, level by level: contiguous rows of hex."""
    out = [np.frombuffer("".join(digests.to_pylist()).encode(), dtype=np.uint8).reshape(-1, HEX)]
    for _ in range(_n_levels(n)):
        runs = memoryview(out[-1].reshape(-1))
        hashed = "".join([hashlib.sha256(runs[at : at + FANOUT * HEX]).hexdigest() for at in range(0, len(runs), FANOUT * HEX)])
        out.append(np.frombuffer(hashed.encode(), dtype=np.uint8).reshape(-1, HEX))
    return out


def _siblings(level: np.ndarray) -> list[bytes]:
    """For each node of a level, the hex of the others in its run, left to right."""
    full = len(level) // FANOUT * FANOUT
    out: list[bytes] = []
    for begin, end, size in ((0, full, FANOUT), (full, len(level), len(level) - full)):
        if end > begin:
            at = np.arange(begin, end)
            places = at - (at - begin) % size
            others = level[places[:, None] + _OTHERS[size - 1][(at - begin) % size]].tobytes()
            width = (size - 1) * HEX
            out.extend([others[i * width : (i + 1) * width] for i in range(end - begin)])
    return out


def fold(digest: str, ats: list[int], others: list[bytes]) -> str:
    """The root above a node: its run's hash, level by level, with the node at its place among the others."""
    for at, rest in zip(ats, others):
        digest = hashlib.sha256(rest[: at * HEX] + digest.encode() + rest[at * HEX :]).hexdigest()
    return digest


def _paths(levels: list[np.ndarray]) -> Iterator[tuple[list[int], list[bytes]]]:
    """For each node of the block: its places in runs and the others there, up to the block's root."""
    sides = [_siblings(x) for x in levels[:-1]]
    for i in range(len(levels[0])):
        steps = [i // FANOUT**k for k in range(len(sides))]
        yield [j % FANOUT for j in steps], [s[j] for s, j in zip(sides, steps)]


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("tree", "block")


def _up(nodes: DataFrame) -> DataFrame:
    """The next round: a node for each block."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        root = _matrices(table.column("digest"), n)[-1][0].tobytes().decode()
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [root], "n": [-(-n // BLOCK)]})

    return _blocks(nodes).applyInArrow(run, "tree string, pos long, digest string, n long")


def _rounds(nodes: DataFrame, label: str) -> list[DataFrame]:
    """All rounds, up to the one where every tree is a single node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:  # one number
        out.append(materialise(_up(out[-1]), label))
    return out


_PATH = "ats array<int>, others array<binary>"


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, pos`` with ``ats, others``: every node's path, through its block to what its block's root has above."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, upper: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"tree": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "ats": pa.array([], pa.list_(pa.int32())), "others": pa.array([], pa.list_(pa.binary()))})
        table = table.sort_by("pos")
        ats, others = (upper.column(c)[0].as_py() for c in ("ats", "others"))
        found = [(a + ats, o + others) for a, o in _paths(_matrices(table.column("digest"), table.column("n")[0].as_py()))]
        columns = [pa.array([x[k] for x in found], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.binary()))]
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "ats": columns[0], "others": columns[1]})

    return _blocks(nodes.select("tree", "pos", "digest", "n")).cogroup(_blocks(above.withColumn("pos", F.col("pos") * BLOCK))).applyInArrow(run, f"tree string, pos long, {_PATH}")


def build(rows: DataFrame) -> Manifest:
    """Trees over ``rows`` (``doc_id, source, leaf, claimed``)."""
    keyed = rows.withColumn("tree", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")))
    placed = materialise(_numbered(keyed, [F.asc_nulls_first("doc_id"), "leaf"]), "merkle-leaves")
    rounds = _rounds(placed.select("tree", "pos", F.col("leaf").alias("digest"), "n"), "merkle-round")
    roots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    return Manifest(placed, rounds, _rounds(materialise(_numbered(roots, ["source"]), "merkle-sources"), "merkle-top"))


def _above(manifest: Manifest) -> DataFrame:
    """``tree, pos`` of the blocks of leaves, with the path above them, ``subroot`` and ``root``."""
    tops = manifest.tops
    nothing = [F.array().cast("array<int>").alias("ats"), F.array().cast("array<binary>").alias("others")]
    above = tops[-1].select("tree", "pos", *nothing)
    for nodes in reversed(tops[:-1]):
        above = materialise(_down(nodes, above), "merkle-path")
    root = tops[-1].select(F.col("digest").alias("root"))  # one row
    # the path of a source's root belongs to its whole tree
    ends = tops[0].select("pos", F.col("source"), F.col("digest").alias("subroot")).join(above.select("pos", "ats", "others"), "pos").crossJoin(F.broadcast(root))
    ends = ends.withColumnRenamed("source", "tree")
    above = ends.select("tree", F.lit(0).cast("long").alias("pos"), "ats", "others")
    for nodes in reversed(manifest.rounds[1:-1]):
        above = materialise(_down(nodes, above), "merkle-path")
    return above.join(ends.select("tree", "subroot", "root"), "tree")


def _with_paths(manifest: Manifest, kind: str, each) -> DataFrame:
    """A row for each leaf, made by ``each`` from its block's rows, their paths in the block and the rows above it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        top = {c: upper.column(c)[0].as_py() for c in ("ats", "others", "subroot", "root")}
        return each(table, _paths(_matrices(table.column("leaf"), table.column("n")[0].as_py())), top)

    return _blocks(manifest.rows).cogroup(_blocks(_above(manifest).withColumn("pos", F.col("pos") * BLOCK))).applyInArrow(run, kind)


def prove(manifest: Manifest) -> DataFrame:
    """``doc_id, source, pos, leaf, subroot, root, ats, others``: each leaf's places in its runs, and the hex of the others in each."""
    id_type = manifest.rows.schema["doc_id"].dataType.simpleString()

    def each(table: pa.Table, paths: Iterator[tuple[list[int], list[bytes]]], top: dict) -> pa.Table:
        found = [(a + top["ats"], o + top["others"]) for a, o in paths]
        out = table.select(["doc_id", "source", "pos", "leaf"])
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array([top[c]] * len(found)))
        return out.append_column("ats", pa.array([x[0] for x in found], pa.list_(pa.int32()))).append_column("others", pa.array([x[1] for x in found], pa.list_(pa.binary())))

    return _with_paths(manifest, f"doc_id {id_type}, source string, pos long, leaf string, subroot string, root string, {_PATH}", each)


def audit(manifest: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the claimed leaves (else the leaves) folded with the siblings of the tree."""
    id_type = manifest.rows.schema["doc_id"].dataType.simpleString()

    def each(table: pa.Table, paths: Iterator[tuple[list[int], list[bytes]]], top: dict) -> pa.Table:
        rest, above = b"".join(top["others"]), {}
        proofs, folded = [], []
        for claim, (ats, others) in zip([c or own for c, own in zip(table.column("claimed").to_pylist(), table.column("leaf").to_pylist())], paths):
            proofs.append(hashlib.sha256(b"".join(others) + rest).hexdigest())
            own = fold(claim, ats, others)
            if own not in above:  # all honest leaves of a block meet in its root
                above[own] = fold(own, top["ats"], top["others"])
            folded.append(above[own])
        out = table.select(["doc_id", "leaf"])
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array([top[c]] * len(folded)))
        return out.append_column("proof_sha256", pa.array(proofs)).append_column("folded_root", pa.array(folded)).append_column("verified", pa.array([x == top["root"] for x in folded]))

    return _with_paths(manifest, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", each)


#: The audit over the table ``documents``; its recursion climbs one level of all trees at a time.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
  docs AS (
    SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS crc, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
    FROM documents, tab),
  rows AS (SELECT doc_id, tree, crc, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed FROM docs),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows),
  low(level, tree, pos, digest, n) AS (
    SELECT 0, tree, pos, leaf, count(*) OVER (PARTITION BY tree) FROM ranked
    UNION ALL SELECT level + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY level, tree, pos // 16, n),
  subroots AS (SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot FROM low WHERE n = 1),
  high(level, pos, digest, n) AS (
    SELECT 0, spot, subroot, count(*) OVER () FROM subroots
    UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
  top AS (SELECT digest AS root, level AS top_level FROM high WHERE n = 1),
  nodes AS (
    SELECT tree, level, pos, digest FROM low WHERE n > 1
    UNION ALL SELECT s.tree, s.height + h.level, h.pos, h.digest FROM high h, subroots s WHERE h.n > 1),
  runs AS (SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS members FROM nodes GROUP BY ALL),
  climb(doc_id, leaf, tree, level, pos, height, spot, folded, proof) AS (
    SELECT doc_id, leaf, tree, 0, CASE WHEN height = 0 THEN spot ELSE pos END, height, spot, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END, '' FROM ranked JOIN subroots USING (tree)
    UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.level + 1, CASE WHEN c.level + 1 = c.height THEN c.spot ELSE c.pos // 16 END, c.height, c.spot,
      sha256(array_to_string(list_concat(members[:c.pos % 16], [c.folded], members[c.pos % 16 + 2:]), '')), c.proof || array_to_string(list_concat(members[:c.pos % 16], members[c.pos % 16 + 2:]), '')
    FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM climb JOIN subroots USING (tree, height), top WHERE level = height + top_level
"""
