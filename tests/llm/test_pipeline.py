"""The corpus pipeline against its stages done by hand, and its edge cases."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import tokenizers

import __spark_entry__
import corpus_pipeline
from corridor.llm import pii, quality_rules, queries, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rnd = random.Random(21)
    words = [a + b for a in "ba ke li mo nu".split() for b in "dor fin gas hil jup kem lor mun".split()]
    rows = []
    for i in range(70):
        own = [rnd.choice(words) for _ in range(rnd.randint(60, 160))]
        if i % 5 == 0:
            own[3:3] = ["stupid", "idiot", "idiot"]
        if i % 7 == 1:
            own[9:9] = ["mail", f"a{i}@mail.com", "on", "2024-02-29"]
        rows.append((i, " ".join(own)))
    for i in range(8):
        rows += [(100 + i, rows[i][1]), (200 + i, rows[i][1] + " tail")]
    rows += [(300, None), (301, ""), (302, "too short"), (None, rows[2][1]), (None, "word " * 60), (303, "same words here " * 40), (1, rows[1][1])]
    return [(i, t, "en", "src0", len(t or "")) for i, t in rows]


def _folder(spark, path, rows, labels):
    spark.createDataFrame(rows, COLUMNS).withColumnRenamed("source", "score").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_by_hand(spark, tmp_path):
    rows = _rows()
    folder = _folder(spark, tmp_path, rows, [(i, 1, int(i % 5 == 0)) for i in range(70)])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    good = {tuple(r) for r in con.sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept AND doc_id IS NOT NULL").fetchall()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, folder)
    assert first.columns == docs.columns == ["doc_id", "text", "lang", "score", "n_chars"]
    assert {(r["doc_id"],) for r in first.collect() if r["doc_id"] is not None} == good
    lexicon = toxicity.train(first, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [r for r in first.collect() if lexicon.score(r["text"]) < toxicity.THRESHOLD]
    assert 0 < len(left) < first.count()
    second = corpus_pipeline.toxic(spark, first, folder)
    assert sorted(map(str, second.collect())) == sorted(map(str, left)) and second.columns == docs.columns
    sets = []
    for r in left:
        w = r["text"].lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    comp = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, r in zip(comp, left):
        least[c] = min(least.get(c, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    third = corpus_pipeline.near_duplicates(spark, second, folder)
    kept = third.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(least.values())
    fourth = corpus_pipeline.personal_data(spark, third, folder).collect()
    new = {r["text"]: pii.rewrite(r["text"], queries.PSEUDONYM_KEY)[0] for r in kept}
    assert sorted(r["text"] for r in fourth) == sorted(new.values()) and all(r["n_chars"] == len(r["text"]) for r in fourth)
    assert any(a != b for a, b in new.items())
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sorted((str(r["doc_id"]), zlib.crc32(np.array(tok.encode(r["text"], add_special_tokens=False).ids + [2], dtype="<u4").tobytes())) for r in fourth)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in packed) == wanted  # none is longer than a window
    assert all(r["length"] == r["doc_tokens"] for r in packed)


def test_empty_tables_and_key(spark, tmp_path):
    folder = _folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert queries.pseudonym_key(spark) == queries.PSEUDONYM_KEY
    spark.conf.set(queries.KEY_SETTING, "secret")
    try:
        assert queries.pseudonym_key(spark) == b"secret"
    finally:
        spark.conf.unset(queries.KEY_SETTING)


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "pii_pseudonyms", "packing"]
