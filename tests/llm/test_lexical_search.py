"""Ranked lexical search against a plain ranking, and its edge cases."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from corridor.llm import lexical_search
from corridor.llm.terms import NOT_ALNUM, SPACES, count_terms

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return PATTERN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _ranking(docs, items, k):
    """``(item_id, rank, doc_id, score)`` by the definition."""
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if _terms(text):
            asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        for rank, (score, there, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i if there else None, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts, pattern", [(SPACES, "[^\x20\x09-\x0d]+"), (NOT_ALNUM, PATTERN.pattern)])
def test_terms_of_whole_texts(parts, pattern):
    rnd = random.Random(4)
    texts = [None, "", " .\n", *("".join(rnd.choice("abAB1é日-_ .\n\t\x00") for _ in range(rnd.randint(0, 200))) for _ in range(300)), "Ab-1 " * 700_000, "x" * 3_000_000, "last"]
    found = count_terms(pa.array(texts), parts)
    own = [{} for _ in texts]
    for k, (i, n) in enumerate(zip(found.text.tolist(), found.count.tolist())):
        own[i][found.name(k)] = n
    assert own == [dict(Counter(re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in t or "")))) for t in texts]


def test_ranking(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "K9", "日本", "common"]
    text = lambda n: " ".join(rnd.choice(words) if rnd.random() < 0.6 else "Common," for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(150)]
    docs += [(i, docs[7][1]) for i in range(200, 230)] + [(300, None), (301, ""), (302, " ..."), (303, "w1 " * 50_000), (None, "w2 w3"), (7, docs[7][1]), (7, "w4 w5 w5")]
    items = [(i, text(rnd.randint(1, 12))) for i in range(25)] + [(25, None), (26, ""), (27, "absent"), (27, "w1"), (None, "w2")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    for blocks, k in ((lexical_search.BLOCK_POSTINGS, 50), (20, 3)):
        index = lexical_search.build(rows, 6, 3, blocks)
        found = lexical_search.search(index, asked, k, 3, items_per_list=4).select("item_id", "rank", "doc_id", "score")
        assert sorted(map(tuple, found.collect()), key=str) == _ranking(docs, items, k)


def test_edges(spark):
    docs = spark.createDataFrame([("a", "x y", 1, "b"), ("b", "x x", 2, "c")], "doc_id string, text string, score int, term string")
    items = spark.createDataFrame([("i", "X", 1)], "item_id string, text string, rank int")
    index = lexical_search.build(docs, 2)
    assert [r["doc_id"] for r in lexical_search.search(index, items).orderBy("rank").collect()] == ["b", "a"]
    assert lexical_search.search(index, items.limit(0)).count() == 0
    none = lexical_search.build(docs.limit(0), 2)
    assert lexical_search.search(none, items).count() == 0
    lost = lexical_search.build(docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text"), 2)
    assert lexical_search.search(lost, items).count() == 0
