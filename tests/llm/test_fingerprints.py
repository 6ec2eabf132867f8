"""Consistent weighted samples against generalised Jaccard similarity, edited texts, and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from corridor.llm import fingerprints

WORD = re.compile("[^\x20\x09-\x0d]+")


def _similarity(a, b):
    x, y = (Counter(WORD.findall("".join(c.lower() if c.isascii() else c for c in t))) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def _text(rnd, words, n):
    return " ".join(words[min(int(rnd.expovariate(0.05)), len(words) - 1)] for _ in range(n))


def test_collision_rate_is_generalised_jaccard():
    rnd = random.Random(3)
    errors = []
    for k in range(200):
        words = [f"W{i}é{k}" for i in range(300)]  # draws of their own
        a = _text(rnd, words, rnd.randint(5, 400))
        b = fingerprints.edited(a, _text(rnd, words, 300)) if rnd.random() < 0.7 else _text(rnd, words, rnd.randint(5, 400))
        own = fingerprints.Sampler().signatures(pa.array([a, b]))
        errors.append(fingerprints.likeness(own[:1], own[1:])[0] - _similarity(a, b))
    assert abs(np.mean(errors)) < 0.01  # without bias
    assert np.std(errors) < 0.045  # as of so many samples
    # weights count: the same words in other numbers are not alike
    own = fingerprints.Sampler().signatures(pa.array(["a b " * 10 + "c " * 200, "a b " * 10 + "c"]))
    assert abs(fingerprints.likeness(own[:1], own[1:])[0] - 21 / 220) < 0.1


def test_samples_depend_on_the_text_alone():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5_000)]
    texts = [_text(rnd, words, rnd.randint(0, 300)) for _ in range(60)] + ["long " * 900_000 + " ".join(words)]
    small = fingerprints.Sampler(kept=50)
    one_by_one = np.concatenate([small.signatures(pa.array([t])) for t in texts])
    assert (fingerprints.Sampler().signatures(pa.array(texts)) == one_by_one).all()


def _plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        changed = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        sig = fingerprints.Sampler().signatures(pa.array([a, changed, b]))
        text = [x.astype(">u2").tobytes().hex() for x in sig]
        out[i] = (len(a), hashlib.sha256(changed.encode()).hexdigest(), text[0], text[1], np.mean(sig[0] == sig[1]), np.mean(sig[0] == sig[2]))
    return out


def test_compare_edited(spark):
    rnd = random.Random(9)
    words = ["é", "日本🙂", "Alpha", "beta", "γ", "x"]
    texts = [None, "", " \n", "one", "Two WORDS", "lorem ipsum dolor " * 20_000, "same", "same", *(_text(rnd, words, rnd.randint(0, 90)) for _ in range(200))]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    for n in (1, 9):
        found = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))
        assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == _plain(rows)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert plain == {i: x[2] for i, x in _plain(rows).items()}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (None, "c", 1), (4, "x y", 1), (4, "x y", 1), (5, None, 1)], "doc_id long, text string, part int")
    found = fingerprints.compare_edited(docs)
    assert found.count() == 5 and fingerprints.compare_edited(docs.limit(0)).count() == 0
    same = found.where("doc_id = 4").collect()
    assert len({r["fingerprint"] for r in same}) == 1 and 1.0 in {r["near_next"] for r in same}
    alone = fingerprints.compare_edited(spark.createDataFrame([("i", "a b c d")], "doc_id string, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()
