"""Packing documents into fixed windows by non-negative least squares.

Documents are cut into full windows and a rest. Rests fall into length bins of
``BIN`` tokens; combinations of a few bins that fill the window exactly are enumerated,
and non-negative least squares finds how often to use each so that the bins' counts are
met. The rounded counts become slots: the r-th piece of a bin takes a slot by arithmetic.
What rounding leaves is packed by best fit in groups of bounded size.

Only the histogram (one row a bin) reaches the driver. A piece's rank within its bin is
taken within (bin, salt) and shifted by the counts of the salts before, so a bin with a
third of all pieces is ranked by many tasks.

Defined results: null or empty texts are one end id; repeated rows and ids are packed as
pieces of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.llm import tokens
from corridor.session import materialise

WINDOW = 4096
#: Tokens of a length bin, parts of a combination, and pieces of a residual group.
BIN = 16
PARTS = 3
GROUP = 4_000
#: Pieces for each salt beyond the first 64.
PIECES_PER_SALT = 200_000


def combinations(n_bins: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Bin tuples, in falling order, that fill a window of ``n_bins`` bins with at most ``parts``
    parts, and for each bin as many copies of it as fit, with one part for the rest."""
    found: set[tuple[int, ...]] = set()

    def go(rest: int, most: int, left: int, own: tuple[int, ...]) -> None:
        if rest == 0:
            found.add(own)
        elif left:
            for b in range(min(rest, most), (rest - 1) // left, -1):
                go(rest - b, b, left - 1, (*own, b))

    go(n_bins, n_bins, parts, ())
    for b in range(1, n_bins + 1):
        k, rest = divmod(n_bins, b)
        found.add(tuple(sorted([b] * k + [rest] * (rest > 0), reverse=True)))
    return sorted(found)


def solve(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative x that brings ``A x`` near the histogram, by cyclic coordinate descent."""
    columns = [[(b, float(c.count(b))) for b in dict.fromkeys(c)] for c in combos]
    norms = [sum(m * m for _, m in col) for col in columns]
    left = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = sum(m * left[b] for b, m in col) / norms[j]
            new = max(0.0, x[j] + step)
            if (d := new - x[j]) != 0.0:
                x[j] = new
                moved = max(moved, abs(d))
                for b, m in col:
                    left[b] -= m * d
        if moved < 0.25:
            break
    return np.array(x)


@dataclass
class Slots:
    """For each bin: where ranges of ranks begin, and the sequence, copies and place of each range."""

    n_sequences: int
    used: np.ndarray
    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def allot(combos: list[tuple[int, ...]], x: np.ndarray, histogram: np.ndarray) -> Slots:
    """Rounded counts that no bin's pieces fall short of, as slots."""
    left = histogram.astype(np.int64).tolist()
    used = [0] * len(left)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    n = 0
    order = np.argsort(-x, kind="stable").tolist()
    for want in (lambda j: int(x[j] + 0.5), lambda j: 1 << 62):  # the second turn uses what still fills windows exactly
        for j in order:
            parts = {b: combos[j].count(b) for b in combos[j]}
            k = min(want(j), *(left[b] // m for b, m in parts.items()))
            if k <= 0:
                continue
            place = 0
            for b, m in parts.items():
                rows.setdefault(b, []).append((used[b], n, m, place))
                used[b] += k * m
                left[b] -= k * m
                place += m
            n += k
    ranges = {b: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for b, v in rows.items()}
    return Slots(n, np.array(used, dtype=np.int64), ranges)


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: longest first, each into the fullest sequence that holds it."""
    seqs, offs = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_by: dict[int, list[int]] = {}
    spaces: list[int] = []
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(spaces, size)
        if at == len(spaces):
            seq, space, n = n, window, n + 1
        else:
            space = spaces[at]
            seq = open_by[space].pop()
            if not open_by[space]:
                del open_by[space]
                spaces.pop(at)
        seqs[i], offs[i] = seq, window - space
        if space > size:
            rest = space - size
            if rest not in open_by:
                open_by[rest] = []
                bisect.insort(spaces, rest)
            open_by[rest].append(seq)
    return seqs, offs


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: full windows and the rest of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer_path).encode
        end = np.array([tokens.END_ID], dtype="<u2").tobytes()
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                for k, ids in enumerate(encode(texts[at : at + 256].to_pylist())):
                    own = tokens.as_u4(ids + end)
                    for start in range(0, len(own), window):
                        part = own[start : start + window]
                        rows.append(at + k)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                        totals.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def pack(cut: DataFrame, window: int = WINDOW, width: int = BIN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    Full windows get negative sequence ids, slots count from 0, residual groups have
    bit 62 set; each id belongs to one sequence.
    """
    columns = cut.columns
    rows = materialise(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == window).select(*columns, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < window).withColumn("bin", F.ceil(F.col("length") / width).cast("int"))

    n_bins = window // width
    histogram = np.zeros(n_bins + 1, dtype=np.int64)
    for r in rest.groupBy("bin").count().collect():  # one row a bin
        histogram[r["bin"]] = r["count"]
    combos = combinations(n_bins)
    slots = allot(combos, solve(combos, histogram), histogram)

    n_salts = 64 + int(histogram.sum()) // PIECES_PER_SALT
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(n_salts)).cast("int"))
    before = W.partitionBy("bin").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shift = (
        salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
        .select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    own = W.partitionBy("bin", "salt").orderBy("uid")
    numbered = salted.withColumn("rank", F.row_number().over(own) - 1).join(shift, ["bin", "salt"])
    numbered = numbered.select(*columns, "uid", "bin", (F.col("rank") + F.col("shift")).cast("long").alias("rank"))

    used, ranges = slots.used, slots.ranges

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bin", "rank"))
            seq, slot = np.full(len(bins), -1, dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
            for b in np.unique(bins).tolist():
                at = np.flatnonzero((bins == b) & (ranks < used[b]))
                if len(at):
                    low, base, copies, first = ranges[b]
                    k = np.searchsorted(low, ranks[at], side="right") - 1
                    j = ranks[at] - low[k]
                    seq[at], slot[at] = base[k] + j // copies[k], first[k] + j % copies[k]
            out = [batch.column(batch.schema.get_field_index(c)) for c in (*columns, "uid")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(seq), pa.array(slot)], [*columns, "uid", "seq", "slot"])

    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in columns)
    placed = materialise(numbered.mapInArrow(place, f"{kinds}, uid long, seq long, slot long"), "placed")

    so_far = W.partitionBy("seq").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    fitted = placed.where("seq >= 0").select(
        *columns, F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset")
    )

    n_groups = max(1, int(histogram.sum() - used.sum()) // GROUP)
    left = placed.where("seq < 0").withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(n_groups)).cast("long"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        seq, offset = best_fit(pdf["length"].to_numpy(), window)
        out = pdf[list(columns)].copy()
        out["sequence_id"] = (1 << 62) | (pdf["group"].to_numpy() << 32) | seq
        out["offset"] = offset
        return out

    packed = left.groupBy("group").applyInPandas(greedy, f"{kinds}, sequence_id long, offset long")
    return full.unionByName(fitted).unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """All documents, tokenized, cut and packed: one row a piece."""
    return pack(pieces(docs, tokenizer_path, window), window)
