"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts to Latin, digits and
signs that stand for letters to those, ``l`` and ``i`` to one letter, combining and invisible
characters away. An Aho-Corasick automaton finds the lexicon's terms at word beginnings: a
term is the beginning of a word or, where it ends in a blank, a whole word. Hits inside
exception phrases do not count: some are fixed, others are learned, two words with a hit that
several clean rows and no toxic one hold. The score is a logistic function of the summed weights, of
their density (sum over a saturating length) and of a bias.

``train`` learns terms and weights from labelled rows: at most ``TRAIN_ROWS`` of them, picked
by a hash of the id, of which near copies count once (of rows whose least shingle hash agrees
the one whose text has the least hash, so that the sample depends on the rows alone).
A term's weight is its log odds; of a chain of beginnings that the same documents hold, the
longest is kept, and terms that a kept, shorter one covers are left out. Rare terms are left
out as well (``LEAST_SHARE`` of the toxic rows). The score's coefficients are fitted on rows
measured by terms that were learned from the other half of the rows. Scoring is one pass without a shuffle.

Defined results: null and empty texts have the score of a text without hits; where no
labelled row exists every score is 0; repeated rows are scored alike; null labels are not
learned from; very long texts are matched whole; other columns stay, but columns named
``score`` and ``predicted`` give way to the result's; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.session import materialise

#: Labelled rows used at most, by hash of the id: a bound on what training reads closely.
TRAIN_ROWS = 12_000
#: A term must be in this share of the toxic training rows, and in so many.
LEAST_SHARE = 0.01
LEAST_ROWS = 4
#: Least log odds of a term.
LEAST_WEIGHT = 2.0
#: Toxic rows with a term for each clean one, at least.
LEAST_RATIO = 8
#: Clean rows that hold a learned exception, at least.
LEAST_CLEAN = 5
#: Beginnings of words that are tried as terms.
SHORTEST, LONGEST = 3, 10
#: Words after which length counts no further against a text.
LONG_TEXT = 60.0
THRESHOLD = 0.7

#: Look-alike letters, and signs used for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "ӏ": "l", "ո": "n", "ս": "u", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
    "υ": "u", "χ": "x", "η": "n", "μ": "u", "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ø": "o", "ƒ": "f",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases whose words are no insult, folded like texts.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clown school", "pond scum removal", "stupid simple", "pathetic fallacy")

_WORD = re.compile(r"[^\W_]+")
_SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[013457890@$!|]+(?=[^\W\d_])|(?<!\w)[013457890@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[0134578]+\b")
_INVISIBLE = re.compile("[­͏̀-ͯ​-‏⁠﻿]")
_SIGNS = str.maketrans(DIGITS)
_LETTERS = str.maketrans(LOOK_ALIKES | {"l": "i"})


def fold(text: str) -> str:
    """The text as the lexicon sees it: folded words between single blanks."""
    if text.isascii():
        low = text.lower()
    else:
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        low = _INVISIBLE.sub("", text.lower())
    low = _SIGN_IN_WORD.sub(lambda m: m.group().translate(_SIGNS), low).translate(_LETTERS)
    return " " + " ".join(_WORD.findall(low)) + " "


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that do not overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _within(place: int, spans: list[tuple[int, int]]) -> bool:
    """Whether one of the merged spans holds ``place``."""
    at = bisect_right(spans, place, key=itemgetter(0)) - 1
    return at >= 0 and place < spans[at][1]


def terms_of(folded: str) -> set[str]:
    """Candidate terms of a folded text: beginnings of its words, and whole words with a blank behind."""
    out: set[str] = set()
    for w in set(folded.split()):
        if len(w) >= SHORTEST:
            out.add(w + " ")
            for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                out.add(w[:n])
    return out


def sketch(folded: str) -> int:
    """The least hash of a text's 5-word shingles: near copies often agree in it."""
    words = folded.split()
    n = max(1, len(words) - 4)
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(n)) >> 1


@dataclass
class Lexicon:
    """Terms with weights, exception phrases and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = 0.0
    by_sum: float = 0.0
    by_density: float = 0.0
    trained: bool = False
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker builds its own

    def matcher(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(" " + term, (len(term.rstrip()), weight))
            for phrase in self.exceptions:
                found.add_word(fold(phrase), (len(fold(phrase)) - 2, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Places of the terms outside exceptions, with their weights."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.matcher().iter(folded):
            stop = end if folded[end] == " " and (weight is None or n < end) and folded[end - n : end].strip() == folded[end - n : end] else end + 1
            start = stop - n
            if weight is None:
                spared.append((start, stop))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        spared = _merged(spared)
        return {s: w for s, w in best.items() if not _within(s, spared)}

    def features(self, text: str | None) -> tuple[float, float]:
        """Summed weights, and their sum for each unit of length."""
        if not text or not (self.weights or self.exceptions):
            return 0.0, 0.0
        folded = fold(text)
        total = sum(self.hits(folded).values())
        if total == 0.0:
            return 0.0, 0.0
        words = folded.count(" ") - 1
        return total, total / (words * LONG_TEXT / (words + LONG_TEXT))

    def phrases(self, folded: str) -> set[str]:
        """Each word that a term hits, with the word before it and with the one behind."""
        out: set[str] = set()
        for start in self.hits(folded):
            end = folded.index(" ", start)
            before, behind = folded.rfind(" ", 0, max(0, start - 1)), folded.find(" ", end + 1)
            if start > 1:
                out.add(folded[before + 1 : end])
            if behind > 0:
                out.add(folded[start:behind])
        return out

    def score(self, text: str | None) -> float:
        """0 to 1, higher where the text is likelier toxic."""
        if not self.trained:
            return 0.0
        total, density = self.features(text)
        z = self.bias + self.by_sum * math.log1p(total) + self.by_density * math.log1p(density)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _bounded(labelled: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` of the labelled rows, by hash of the id; all where they are fewer."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * rows / n)))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms and weights from counts of rows."""
    weight = {}
    for t, k in toxic.items():
        w = math.log((k + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
        if w >= LEAST_WEIGHT and k >= LEAST_RATIO * clean.get(t, 0):
            weight[t] = w
    longer: Counter[str] = Counter()
    for t, k in toxic.items():
        if t in weight and len(t) > SHORTEST:
            longer[t[:-1]] = max(longer[t[:-1]], k)
    kept: dict[str, float] = {}
    for t in sorted(weight, key=len):
        if any(t[:n] in kept for n in range(SHORTEST, len(t))):
            continue  # a shorter term covers it
        if longer[t] < 0.95 * toxic[t]:  # the last of a chain that the same rows hold
            kept[t] = weight[t]
    return kept


def fit_score(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Bias and two coefficients of a logistic regression, by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), np.log1p(x)])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 5e-2, 5e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from ``labels`` (``doc_id, toxic``) and the texts of ``docs``."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = F.broadcast(_bounded(known, rows))  # two numbers a row, at most about `rows` of them
    joined = docs.where("text IS NOT NULL").select("doc_id", "text").join(picked, "doc_id").select("toxic", "text")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [fold(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(t) for t in texts], pa.int64()), pa.array(texts)], ["toxic", "sketch", "text"])

    sample = joined.mapInArrow(folded, "toxic int, sketch long, text string").groupBy("toxic", "sketch").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = sample.withColumn("half", (F.col("sketch") % 2).cast("int"))
    sample = materialise(sample, "toxicity-sample")
    sizes = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = ([sizes.get((y, h), 0) for h in (0, 1)] for y in (1, 0))
    if not sum(n_toxic):
        return Lexicon({})

    def count(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for batch in batches:
                for half, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    terms = terms_of(text.as_py())
                    found[half].update(terms if only is None else terms & only)
            terms = list(found[0] | found[1])
            halves = [pa.array([f[t] for t in terms], pa.int64()) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *halves], ["term", "n0", "n1"])

        return run

    def counts(toxic: int, only: set[str] | None, least: int) -> dict[str, tuple[int, int]]:
        texts = sample.where(F.col("toxic") == toxic).select("half", "text")
        sums = texts.mapInArrow(count(only), "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        # of a bounded sample; each term in a hundredth of its toxic rows at least
        return {r["term"]: (r["n0"], r["n1"]) for r in sums.where(F.col("n0") + F.col("n1") >= least).collect()}

    toxic = counts(1, None, max(LEAST_ROWS, math.ceil(LEAST_SHARE * sum(n_toxic))))
    clean = counts(0, set(toxic), 1)

    def lexicon_of(halves: tuple[int, ...]) -> Lexicon:
        some = lambda found: {t: k for t, n in found.items() if (k := sum(n[h] for h in halves)) > 1}
        return Lexicon(choose(some(toxic), {t: sum(n[h] for h in halves) for t, n in clean.items()}, sum(n_toxic[h] for h in halves), sum(n_clean[h] for h in halves)))

    whole = lexicon_of((0, 1))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(y, h, p) for y, h, t in zip(*(c.to_pylist() for c in batch.columns)) for p in whole.phrases(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["toxic", "half", "phrase"])

    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    clean_half = [n(f"toxic = 0 AND half = {h}").alias(f"n{h}") for h in (0, 1)]
    spared = sample.select("toxic", "half", "text").mapInArrow(around, "toxic int, half int, phrase string").groupBy("phrase").agg(n("toxic = 1").alias("n"), *clean_half)
    # phrases of a bounded sample
    learned = [(r["phrase"], (r["n0"], r["n1"])) for r in spared.where(f"n = 0 AND n0 + n1 >= {LEAST_CLEAN}").collect()]

    def with_exceptions(halves: tuple[int, ...]) -> Lexicon:
        found = lexicon_of(halves)
        found.exceptions = (*EXCEPTIONS, *sorted(p for p, k in learned if sum(k[h] for h in halves) >= LEAST_CLEAN))
        return found

    others = (with_exceptions((1,)), with_exceptions((0,)))  # a row's features are of terms learned without it

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [others[h].features(t.as_py()) for h, t in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], ["toxic", "total", "density"])

    x = np.array(sorted(map(tuple, sample.select("toxic", "half", "text").mapInArrow(measure, "toxic int, total double, density double").collect())))
    lexicon = with_exceptions((0, 1))
    lexicon.bias, lexicon.by_sum, lexicon.by_density = fit_score(x[:, 1:], x[:, 0])
    lexicon.trained = True
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, from their texts alone."""
    docs = docs.drop("score", "predicted")
    kind = T.StructType(list(docs.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.score(t.as_py()) for t in batch.column(at)]
            columns = [*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= THRESHOLD) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, kind)


def filter_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
