"""Quality grades by ordinal cumulative-link regression on hashed text.

``P(grade <= k) = 1 / (1 + exp(w.x - t_k))`` with one weight vector for all grades and rising
thresholds ``t_k``. A text's features are hashed into ``SIZE`` places: its words, their shapes
(runs of capitals, small letters, digits and each sign) by share, and coarse shares of the
whole text (repeated words, words equal to the one before, repeated lines, capitals, signs,
length). ``train`` fits on at most ``TRAIN_ROWS`` rated rows, picked by a hash of the id; the
features of these alone reach the driver. ``score`` is one pass without a shuffle and gives
the expected grade and, for each grade above the lowest, the probability of it or a better one.

Defined results: null and empty texts are scored by the features of an empty text; without
rated rows, or with one grade alone, that grade (or 0) is expected of every text; null grades
are not learned from; repeated rows are scored alike; very long texts are measured whole; other
columns stay as they are, but columns named ``expected_grade`` and ``tails`` give way to the
result's; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 4096
#: Rated rows used at most, and words a worker keeps the places of.
TRAIN_ROWS = 3_000
CACHE_WORDS = 500_000
#: Longer words are looked at anew each time, so that the kept ones stay small.
CACHE_CHARS = 64
STEPS = 150
RIDGE = 2e-4
_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m.group().isupper() else "a" if m.group().islower() else "Aa"), (re.compile(r"\d+"), lambda m: "9"))
_SIGN_RUN = re.compile(r"([^\w\s])\1+")
_KNOWN: dict[str, tuple[int, int, int]] = {}


def _place(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % SIZE


def _places(word: str) -> tuple[int, int, int]:
    """The places of a word and of its shape, and its upper-case characters."""
    found = _KNOWN.get(word)
    if found is None:
        shape = _SIGN_RUN.sub(r"\1+", word)
        for pattern, name in _SHAPES:
            shape = pattern.sub(name, shape)
        found = (_place("word", word.lower()), _place("shape", shape), sum(map(str.isupper, word)))
        if len(word) <= CACHE_CHARS:
            if len(_KNOWN) > CACHE_WORDS:
                _KNOWN.clear()
            _KNOWN[word] = found
    return found


def features(text: str | None) -> np.ndarray:
    """The hashed features of a whole text, a dense vector of ``SIZE``."""
    words = (text or "").split()
    x = np.zeros(SIZE)
    if not words:
        x[_place("text", "empty")] = 1.0
        return x
    n = len(words)
    counts = Counter(words)
    places = np.array([_places(w) for w in counts], dtype=np.int64)
    share = np.array(list(counts.values()), dtype=np.float64) / n
    x += np.sqrt(np.bincount(places[:, 0], weights=share, minlength=SIZE)) * 0.3
    x += np.sqrt(np.bincount(places[:, 1], weights=share, minlength=SIZE))
    lines = [line for line in text.split("\n") if line.strip()]
    capitals = sum(k * c for k, c in zip(counts.values(), places[:, 2].tolist()))
    whole = {
        "repeated": 1 - len(counts) / n,
        "again": sum(map(eq, words, words[1:])) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "capitals": capitals / len(text),
        "words": min(1.0, np.log2(n + 1) / 16),
        "letters": min(1.0, len(text) / n / 20),
    }
    for name, v in whole.items():
        x[_place(name, str(int(v * 10)))] += 1.0
        x[_place(name, "value")] += v
    return x


@dataclass
class Ordinal:
    """Shared weights and rising thresholds; ``grades`` are those the thresholds part."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, text: str | None) -> np.ndarray:
        """Probabilities of at least each grade above the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - features(text) @ self.weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam over all rows."""
    grades = sorted({int(v) for v in y})
    k = np.searchsorted(grades, y)
    n_cut = len(grades) - 1
    if n_cut < 1:
        return Ordinal(np.zeros(SIZE), np.empty(0), grades or [0])
    x = x.astype(np.float32)
    share = np.array([(k <= j).mean() for j in range(n_cut)])
    w, cut = np.zeros(SIZE), np.log(share / (1 - share))
    p = np.concatenate([w, cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])  # gaps by their logarithms: thresholds cannot cross
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w = p[:SIZE]
        gap = np.exp(p[SIZE + 1 :])
        cut = p[SIZE] + np.concatenate([[0.0], np.cumsum(gap)])
        z = x @ w.astype(np.float32)
        sig = 1 / (1 + np.exp(np.clip(z[:, None] - cut[None, :], -30, 30)))  # P(grade <= j)
        full = np.column_stack([np.zeros(len(x)), sig, np.ones(len(x))])
        prob = np.maximum(full[np.arange(len(x)), k + 1] - full[np.arange(len(x)), k], 1e-9)
        slope = np.column_stack([np.zeros(len(x)), sig * (1 - sig), np.zeros(len(x))])
        up, low = slope[np.arange(len(x)), k + 1] / prob, slope[np.arange(len(x)), k] / prob
        g_cut = np.zeros(n_cut)
        for j in range(n_cut):
            g_cut[j] = (-up[k == j].sum() + low[k == j + 1].sum()) / len(x)
        g_w = x.T @ ((up - low) / len(x)).astype(np.float32) + RIDGE * w
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gap])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        rate = 0.15 * (1 - step / (STEPS + 1))
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    cut = p[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(p[SIZE + 1 :]))])
    return Ordinal(p[:SIZE], cut, grades)


def train(docs: DataFrame, ratings: DataFrame, rows: int = TRAIN_ROWS) -> Ordinal:
    """A model from ``ratings`` (``doc_id, grade``) and the texts of ``docs``."""
    known = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * rows / n)))
    joined = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about `rows` pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            places = [np.flatnonzero(v) for v in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh3_64_intdigest(t.as_buffer().to_pybytes()) >> 1 for t in batch.column(1)], pa.int64()),
                    pa.array([p.astype("<i2").tobytes() for p in places], pa.binary()),
                    pa.array([v[p].astype("<f4").tobytes() for p, v in zip(places, found)], pa.binary()),
                ],
                ["grade", "text_hash", "at", "value"],
            )

    sample = joined.select("grade", "text").mapInArrow(run, "grade int, text_hash long, at binary, value binary")
    found = sorted(sample.collect(), key=lambda r: (r["text_hash"], r["grade"]))  # bounded: features of at most about `rows` texts
    x = np.zeros((len(found), SIZE), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], dtype="<i2")] = np.frombuffer(r["value"], dtype="<f4")
    return fit(x, np.array([r["grade"] for r in found], dtype=np.int64))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails`` (probability of at least each higher grade)."""
    docs = docs.drop("expected_grade", "tails")
    at = docs.columns.index("text")
    kind = T.StructType(list(docs.schema.fields)).add("expected_grade", T.DoubleType()).add("tails", T.ArrayType(T.DoubleType()))
    steps = np.diff(model.grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [model.tails(t.as_py()) for t in batch.column(at)]
            expected = pa.array([model.grades[0] + float(t @ steps) for t in tails], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, expected, pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))], [*batch.schema.names, "expected_grade", "tails"])

    return docs.mapInArrow(run, kind)
