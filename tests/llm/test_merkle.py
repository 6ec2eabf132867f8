"""The Merkle manifest against a plain tree, proofs that fold to the root, and edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corridor.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text=None):
    values = [*row[:4], row[4] if text is None else text]
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _climb(nodes):
    """The root, and each node's siblings and places."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, j in enumerate(at):
            base = j // 16 * 16
            run = level[base : base + 16]
            paths[i].append((j - base, run[: j - base] + run[j - base + 1 :]))
        at = [j // 16 for j in at]
        level = [_h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def _plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = (own, *_climb([_leaf(r) for r in own]))
    root, tops = _climb([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            lowered = None if r[4] is None else "".join(c.lower() if c.isascii() else c for c in r[4])
            node = _leaf(r, lowered) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else _leaf(r)
            whole = path + top
            for j, others in whole:
                node = _h(*others[:j], node, *others[j:])
            out.append((r[0], _leaf(r), subroot, root, _h(*(x for _, others in whole for x in others)), node, node == root))
    return sorted(out, key=str)


def _audit(rows):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return merkle.audit(merkle.build(merkle.leaves(rows, crc, text=lowered)))


@pytest.mark.parametrize("sizes", [(1,), (1, 1, 1), (16, 17, 2), (4097, 300, 1, 256), tuple([2] * 40)])
def test_audit(spark, sizes):
    rnd = random.Random(len(sizes))
    ids = rnd.sample(range(-50, 10**6), sum(sizes))
    rows = []
    for k, n in enumerate(sizes):
        source = None if k == 1 else ("é" if k == 2 else f"s{k}")
        rows += [(ids.pop(), source, rnd.choice(["en", None]), rnd.choice([3, None]), rnd.choice(["Ab é", "", None, "low"])) for _ in range(n)]
    rows += [rows[0], rows[0]] if len(sizes) == 3 else []
    rows += [(None, "s0", "x", 1, "T"), (None, "s0", "x", 1, "U")] if sizes[0] == 16 else []
    found = _audit(spark.createDataFrame(rows, KIND).repartition(5))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == _plain(rows)


def test_proofs_fold_to_the_root(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", "en", i, "text " * (i % 7) + ("long " * 100_000 if i == 5 else "")) for i in range(700)], KIND)
    found = merkle.prove(merkle.build(merkle.leaves(rows))).collect()
    assert len(found) == 700 and len({r["root"] for r in found}) == 1
    assert all(merkle.fold(r["leaf"], r["ats"], [bytes(o) for o in r["others"]]) == r["root"] for r in found)
    assert not any(merkle.fold(r["leaf"][::-1], r["ats"], [bytes(o) for o in r["others"]]) == r["root"] for r in found)


def test_edges(spark):
    rows = spark.createDataFrame([(1, "a", "en", 1, "x")], KIND)
    assert _audit(rows.limit(0)).count() == 0
    clashing = rows.selectExpr("*", *(f"'x' AS `{c}`" for c in ("tree", "pos", "n", "leaf", "claimed", "root", "block", "digest")))
    assert _audit(clashing).collect() == _audit(rows).collect()
