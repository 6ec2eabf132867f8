"""Language identification by rank-order n-gram profiles.

A profile is the ``top`` most frequent 1- to 3-grams of a language, in rank order.
A document's own most frequent n-grams are ranked alike and its distance to a
language is the sum of rank differences, ``top`` for an n-gram the profile lacks.
Training counts n-grams over every labelled training text: counts are summed per
batch in numpy, then by Spark; only the ranked heads (``top`` rows a language) reach
the driver. Prediction is one pass without a shuffle.

Defined results: null text or text without a letter is ``und`` with score 0; ties of
frequency break by n-gram code, ties of distance by language name; repeated rows are
predicted alike; very long texts are counted whole; where no training text exists every
document is ``und``; an empty table gives an empty result; columns besides those named are
ignored. Every value of ``lang`` in the training rows is a language, with ``top`` rows of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TOP = 300
#: Folded codes counted at once in training.
PIECE = 4_000_000
#: Bits per character code in an n-gram: three characters fit a 64-bit integer.
BITS = 21
_FOLD: dict[int, np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything that is no letter (basic plane)."""
    if 0 not in _FOLD:
        table = np.full(0x10000, 32, dtype=np.uint32)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low[0]) if low else c
        _FOLD[0] = table
    return _FOLD[0]


def fold(text: str) -> np.ndarray:
    """Folded code points, framed by one space and with runs of spaces reduced to one."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _fold_table()
    if codes.max() < 0x10000:
        out = table[codes]
    else:
        low = np.minimum(codes, 0xFFFF)
        wide = np.array([c if unicodedata.category(chr(c))[0] == "L" else 32 for c in codes[codes > 0xFFFF].tolist()], dtype=np.uint32)
        out = table[low]
        out[codes > 0xFFFF] = wide
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of folded codes, and their counts. A lone space is no 1-gram."""
    small = np.unique(codes)
    if len(small) <= 1023:
        # dense ids keep the keys in 32 bits, which sort several times faster
        ids = np.searchsorted(small, codes).astype(np.uint32) + np.uint32(1)
        two = (ids[:-1] << np.uint32(10)) | ids[1:]
        three = (two[:-1] << np.uint32(10)) | ids[2:] if len(ids) > 2 else ids[:0]
        keys, counts = _count(np.concatenate([ids[codes != 32], two, three]))
        back = np.concatenate([[0], small]).astype(np.int64)
        a, b, c = keys >> 20, (keys >> 10) & 1023, keys & 1023
        wide = (back[a] << (2 * BITS)) | (back[b] << BITS) | back[c]
        return wide, counts
    long = codes.astype(np.int64)
    two = (long[:-1] << BITS) | long[1:]
    three = (two[:-1] << BITS) | long[2:]
    return _count(np.concatenate([long[codes != 32], two, three]))


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def ranked(text: str | None, top: int) -> np.ndarray | None:
    """The ``top`` n-grams by falling count, then by code; None without a letter."""
    if not text:
        return None
    codes = fold(text)
    if len(codes) < 2:
        return None
    keys, counts = ngrams(codes)
    order = np.argsort(-counts, kind="stable") if len(keys) <= top else _head(keys, counts, top)
    return keys[order[:top]]


def _head(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    least = np.partition(counts, len(counts) - top)[len(counts) - top]
    some = np.flatnonzero(counts >= least)
    return some[np.lexsort((keys[some], -counts[some]))]


def pieces(texts: list[str]) -> Iterator[np.ndarray]:
    """Folded codes of whole texts, one behind the other, in arrays of about ``PIECE`` codes or of one text.

    Each text is framed by blanks, so that two blanks in a row are found between texts alone.
    """
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        codes = fold(text)
        if held and size + len(codes) > PIECE:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(codes)
        size += len(codes)
    if held:
        yield np.concatenate(held)


def _between(keys: np.ndarray) -> np.ndarray:
    """Where an n-gram holds two blanks in a row: it lies between two texts and belongs to neither."""
    low = (1 << BITS) - 1
    last, middle, first = keys & low, (keys >> BITS) & low, keys >> (2 * BITS)
    return ((last == 32) & (middle == 32)) | ((middle == 32) & (first == 32))


def train(docs: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """Language -> its ranked n-grams, over every row of ``docs`` with text and lang.

    Each text is counted on its own: how rows fall into batches changes nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for codes in pieces(texts):
                    if len(codes) < 2:
                        continue
                    keys, counts = ngrams(codes)
                    own = ~_between(keys)
                    keys, counts = keys[own], counts[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())],
                        ["lang", "gram", "n"],
                    )

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    head = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in head.select("lang", "rank", "gram").collect():  # top rows for each language
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(found.items())}


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """``doc_id, lang_pred, score``: the nearest profile; score is its lead over the second, 0 to 1."""
    langs = sorted(profiles)
    tables = []
    for lang in langs:
        grams = np.array(profiles[lang], dtype=np.int64)
        order = np.argsort(grams)
        tables.append((grams[order], order))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def distance(own: np.ndarray) -> list[float]:
        place = np.arange(len(own))
        most = max(1, len(own)) * top
        out = []
        for grams, rank in tables:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            gap = np.where(grams[at] == own, np.abs(rank[at] - place), top)
            out.append(float(np.minimum(gap, top).sum()) / most)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            for text in batch.column(1):
                own = ranked(text.as_py(), top)
                if own is None or not langs:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                d = distance(own)
                best = min(range(len(d)), key=lambda i: (d[i], i))
                rest = min((x for i, x in enumerate(d) if i != best), default=1.0)
                preds.append(langs[best])
                scores.append(min(1.0, max(0.0, (rest - d[best]) / rest)) if rest > 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
