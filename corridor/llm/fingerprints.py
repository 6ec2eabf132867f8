"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (A-Z lower-cased) with their counts. For each of
``SAMPLES`` samples every word draws, from hashes of itself, r and c from Gamma(2, 1) and a
uniform b; a weight w falls to the level ``t = floor(ln w / r + b)``, and the word whose
``c / exp(r (t - b) + r)`` is least wins. The sample is the winner with its level, kept as 16
bits of its hash. Two texts share a sample with the probability of their generalised Jaccard
similarity, the sum of lesser weights over that of greater ones, whatever the rest of the
corpus; ``likeness`` is the share of equal samples.

The draw of a word with a count depends on nothing else, so a worker computes it once for a
slice of texts and keeps what came early (a bounded table); a text's samples are minima over
the rows of its words. The least value and the hash travel in one number: the hash takes the
place of the value's lowest bits.

``compare_edited`` fingerprints each document, the document with its second half replaced by
the beginning of its successor in the order of ids, and compares both, and the successor too.
Ranges of ids are sorted apart; only the last row of a range waits for the next one's first.

Defined results: null and empty texts and texts without words have fingerprints of zeros,
which are alike; equal texts have equal fingerprints. Null ids come first, rows of equal ids
by a hash of their texts; equal rows follow each other. The last row's successor is the
first, a single row's itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.llm.shingling import mix
from corridor.llm.terms import SPACES, count_terms
from corridor.session import materialise

#: Samples of a fingerprint.
SAMPLES = 128
#: Words with a count whose draws a worker keeps, draws made at once, bytes of text worked on at once.
KEPT = 60_000
AT_ONCE = 256
SLICE = 2 << 20
_LOW = np.uint64(0xFFFF)
#: A constant for each of four hashes and each sample.
_SALT = mix(np.arange(1, 4 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(4, SAMPLES)


def _gamma(bits: np.ndarray) -> np.ndarray:
    """Numbers from Gamma(2, 1): of two uniform ones, half of the bits each."""
    a, b = (bits >> np.uint64(32)).astype(np.float64), (bits & np.uint64(0xFFFFFFFF)).astype(np.float64)
    a += 0.5
    b += 0.5
    a *= b
    np.log(a, out=a)
    return math.log(2.0**64) - a


def draws(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word and count, every sample's value; as whole numbers, which keep the order, with the winner's hash in the low bits."""
    out = np.empty((len(terms), SAMPLES), dtype=np.uint64)
    weights = np.log(counts)
    for at in range(0, len(terms), AT_ONCE):
        own = terms[at : at + AT_ONCE, None]
        r, c = _gamma(mix(own ^ _SALT[0])), _gamma(mix(own ^ _SALT[1]))
        b = (mix(own ^ _SALT[2]) >> np.uint64(12)).astype(np.float64) * 2.0**-52
        t = np.floor(weights[at : at + AT_ONCE, None] / r + b)
        b -= t
        b -= 1
        b *= r
        np.exp(b, out=b)
        b *= c
        name = mix((own ^ _SALT[3]) + t.astype(np.int64).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        out[at : at + AT_ONCE] = (b.view(np.uint64) & ~_LOW) | (name & _LOW)
    return out


class Sampler:
    """Fingerprints texts; keeps the draws of the first ``KEPT`` words with a count, and those of the last call."""

    def __init__(self, kept: int = KEPT) -> None:
        self.limit = kept
        self.keys = np.empty(0, dtype=np.uint64)
        self.table = np.empty((0, SAMPLES), dtype=np.uint64)
        self.last = self.keys, self.table

    def _rows(self, terms: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Draws of distinct words with counts, in the order of their ``keys``."""
        out = np.empty((len(keys), SAMPLES), dtype=np.uint64)
        new = np.arange(len(keys))
        for known, table in ((self.keys, self.table), self.last):
            if len(known) and len(new):
                at = np.minimum(np.searchsorted(known, keys[new]), len(known) - 1)
                found = known[at] == keys[new]
                out[new[found]] = table[at[found]]
                new = new[~found]
        out[new] = draws(terms[new], counts[new])
        self.last = keys, out
        room = min(self.limit - len(self.keys), len(new))
        if room > 0:
            both = np.concatenate([self.keys, keys[new[:room]]])
            order = np.argsort(both)
            self.keys, self.table = both[order], np.concatenate([self.table, out[new[:room]]])[order]
        return out

    def signatures(self, texts: pa.Array) -> np.ndarray:
        """A row of ``SAMPLES`` 16-bit numbers for each text."""
        found = count_terms(texts, SPACES)
        out = np.zeros((len(texts), SAMPLES), dtype=np.uint16)
        keys, firsts, back = np.unique(mix(found.term + found.count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        table = self._rows(found.term[firsts], found.count[firsts], keys)
        bounds = np.searchsorted(found.text, np.arange(len(texts) + 1))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b > a:
                least = table[back[a : min(b, a + 8192)]].min(axis=0)
                for more in range(a + 8192, b, 8192):
                    least = np.minimum(least, table[back[more : min(b, more + 8192)]].min(axis=0))
                out[i] = least & _LOW
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row."""
    return (a == b).mean(axis=1)


_SAMPLERS: list[Sampler] = []


def sampler() -> Sampler:
    """The worker's sampler: one, so that its table serves all its tasks."""
    if not _SAMPLERS:
        _SAMPLERS.append(Sampler())
    return _SAMPLERS[0]


def _binary(signatures: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in signatures.astype(">u2")], pa.binary())


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint``: the samples of each whole text, as hex."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler()
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(own.signatures(part.column(1)))], ["doc_id", "fingerprint"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint binary")
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``SLICE`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def edited(text: str, successor: str) -> str:
    """``text`` with its last half of code points replaced by as many of the successor's first, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT_KIND = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[str], signatures: np.ndarray) -> list[pa.Array]:
    """Result columns of all texts but the last; each one's successor is the one behind it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    others = sampler().signatures(pa.array(changed, pa.string()))
    own = signatures[:-1]
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        _binary(own),
        _binary(others),
        pa.array(likeness(own, others)),
        pa.array(likeness(own, signatures[1:])),
    ]


def compare_edited(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the fingerprints of each document and of its edited text, and how near it is to that and to its successor."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"tie": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "tie", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ends = ["part", "first_text", "last_id", "last_text"]
    kind = f"doc_id {id_type}, {_RESULT_KIND}, part int, first_text string, last_id {id_type}, last_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # the range's first text; its last row so far, with its samples
        id_arrow = None
        for batch in batches:
            for part in _slices(batch):
                ids, texts = part.column(0), part.column(1).to_pylist()
                id_arrow = ids.type
                own = sampler().signatures(part.column(1))
                if last is None:
                    first = texts[0]
                else:
                    ids, texts, own = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate([last[2], own])
                n = len(texts) - 1
                last = (ids.slice(n), texts[n], own[n:])
                if n:
                    yield pa.RecordBatch.from_arrays([ids.slice(0, n), *_compared(texts, own), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, id_arrow), pa.nulls(n, pa.string())], ["doc_id", *_RESULT, *ends])
        if last is not None:
            none = [pa.nulls(1, t) for t in (id_arrow, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            own = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), last[0], pa.array([last[1]])]
            yield pa.RecordBatch.from_arrays([*none, *own], ["doc_id", *_RESULT, *ends])

    found = materialise(rows.mapInArrow(run, kind), "fingerprints")
    edges = found.where("part IS NOT NULL").select(*ends)
    # numbers of ranges alone; texts meet by a join
    numbers = edges.select("part", F.min("part").over(W.partitionBy()).alias("least"), F.lead("part").over(W.orderBy("part")).alias("next"))
    numbers = numbers.select("part", F.coalesce("next", "least").alias("next"))
    pairs = edges.select("part", "last_id", "last_text").join(numbers, "part").join(edges.select(F.col("part").alias("next"), "first_text"), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = [batch.column(k)[i].as_py() for k in (1, 2)]
                own = sampler().signatures(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_compared(texts, own)], ["doc_id", *_RESULT])

    closing = pairs.select("last_id", "last_text", "first_text").mapInArrow(close, f"doc_id {id_type}, {_RESULT_KIND}")
    whole = found.where("part IS NULL").select("doc_id", *_RESULT).union(closing)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return whole.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
