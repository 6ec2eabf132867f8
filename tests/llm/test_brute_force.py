"""Operators against plain implementations of their definitions, and against libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from corridor.llm import arrow_sequences, byte_bpe, language_id, ngram_jaccard, ordinal_quality, packing, progressive_jpeg, quality_rules, queries, toxicity
from corridor.llm.shingling import shingle_sets

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", " \n", "one", "Two WORDS", "é日本🙂 x", "<|ENDOFTEXT|> a", LONG, "same text", "same text"]


def _docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def _ids(texts):
    tok = tokenizers.Tokenizer.from_file(WORD_BPE)
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def _folded(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    return " " + " ".join(letters.split()) + " " if letters.strip() else ""


def _ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << (21 * (len(x[0]) - 1 - i)) for i, c in enumerate(x[0]))))][:top]


def _grams(text):
    f = _folded(text)
    return Counter(g for n in (1, 2, 3) for i in range(len(f) - n + 1) if (g := f[i : i + n]) != " ")


def test_language_profiles_and_distance(spark):
    rnd = random.Random(2)
    syllables = {"aa": ["ka", "to", "mi", "su"], "bb": ["sch", "ein", "und", "ber"], "cc": ["ça", "eau", "oui", "les"]}
    text = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    train = [(lang, text(lang, rnd.randint(1, 30))) for lang in syllables for _ in range(25)]
    rows = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string")
    top = 40
    profiles = language_id.train(rows, top)
    assert profiles == language_id.train(rows.repartition(7), top)
    own = {lang: _ranked(sum((_grams(t) for g, t in train if g == lang), Counter()), top) for lang in syllables}
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    assert profiles == {lang: [code(g) for g in gs] for lang, gs in own.items()}
    texts = [*(text(rnd.choice(list(syllables)), rnd.randint(1, 12)) for _ in range(60)), "12 3", "", None]
    found = {r["doc_id"]: r for r in language_id.predict(_docs(spark, texts), profiles, top).collect()}
    for i, t in enumerate(texts):
        grams = _ranked(_grams(t or ""), top)
        if not grams:
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(k - gs.index(g)), top) if g in gs else top for k, g in enumerate(grams)) for lang, gs in own.items()}
        first, second = sorted(far, key=lambda g: (far[g], g))[:2]
        assert found[i]["lang_pred"] == first and abs(found[i]["score"] - (far[second] - far[first]) / far[second]) < 1e-9


def test_sequences_read_back(spark, tmp_path):
    rnd = random.Random(5)
    texts = [*TEXTS, *(" ".join(rnd.choice(["alpha", "Beta", "γ", "9", ","]) for _ in range(rnd.randint(0, 300))) for _ in range(40))]
    ids = _ids(texts)
    starts = np.cumsum([0, *map(len, ids)])
    for length in (3, 64):  # sequences and documents cross batches
        found = sorted(tuple(r) for r in arrow_sequences.round_trip(_docs(spark, texts), WORD_BPE, length).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
        assert found == [(i, int(starts[i]), len(own), _crc(own)) for i, own in enumerate(ids)]


def test_sequence_file_masks(tmp_path):
    import pyarrow as pa
    import pyarrow.fs as pafs

    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        writer = arrow_sequences.SequenceWriter(sink, 4)
        for own in ([5, 6, 7], [8, 9, 10, 11, 12, 13]):
            writer.append(np.array(own, dtype="<u2").tobytes())
        writer.close()
    file = arrow_sequences.SequenceFile(pafs.LocalFileSystem(), path)
    read = [file.sequence(i) for i in range(3)]
    assert np.concatenate([x[m.astype(bool)] for x, m in read]).tolist() == list(range(5, 14))
    assert [int(np.sum(m)) for _, m in read] == [4, 4, 1] and file.tokens(2, 6).tolist() == list(range(7, 13))
    with pytest.raises(ValueError):
        file.tokens(9, 100)


def test_packing_keeps_all_ids(spark):
    rnd = random.Random(7)
    texts = [*TEXTS, *("w " * rnd.choice((1, 5, 63, 64, 500)) for _ in range(300))]
    ids, window = _ids(texts), 64
    for group in (packing.GROUP, 20):
        packing.GROUP, before = group, packing.GROUP
        try:
            rows = packing.pack_documents(_docs(spark, texts), WORD_BPE, window).collect()
        finally:
            packing.GROUP = before
        pieces, places = {}, {}
        for r in rows:
            pieces.setdefault(r["doc_id"], []).append(r)
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, own in enumerate(ids):
            at = 0
            for r in sorted(pieces.pop(i), key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(own), _crc(own[at : at + r["length"]]))
                at += r["length"]
            assert at == len(own)
        assert not pieces
        for parts in places.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= window
        total = sum(map(len, ids))
        assert total / (len(places) * window) > 0.9


def test_toxicity_against_a_plain_scan():
    rnd = random.Random(9)
    words = ["stupid", "idiot", "stup", "simple", "calm", "trash", "can", "idiots", "x"]
    lexicon = toxicity.Lexicon({"stup": 3.0, "idiot ": 2.0, "trash": 1.5}, ("stupid simple", "trash can"), -1.0, 2.0, 0.5, True)
    for _ in range(400):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
        folded = toxicity.fold(text)
        spared = {i for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(toxicity.fold(p), i) for i in range(i + 1, i + len(toxicity.fold(p)) - 1)}
        total = 0.0
        for i in range(1, len(folded)):
            if folded[i - 1] == " " and i not in spared:
                total += max((w for t, w in lexicon.weights.items() if folded.startswith(t, i)), default=0.0)
        assert abs(lexicon.features(text)[0] - total) < 1e-9
        n = len(folded.split())
        density = total / (n * 60 / (n + 60)) if total else 0.0
        z = -1.0 + 2.0 * math.log1p(total) + 0.5 * math.log1p(density)
        assert abs(lexicon.score(text) - 1 / (1 + math.exp(-z))) < 1e-9
    assert lexicon.score("trash can " * 50_000) == lexicon.score("")


def test_toxicity_filter_equals_score(spark):
    lexicon = toxicity.Lexicon({"idiot": 5.0}, (), -2.0, 2.0, 0.5, True)
    docs = _docs(spark, [*TEXTS, "you idiot", "idiot idiot"])
    kept = {r["doc_id"] for r in toxicity.filter_documents(docs, lexicon).collect()}
    assert kept == {r["doc_id"] for r in toxicity.score(docs, lexicon).where("predicted = 0").collect()} == set(range(len(TEXTS)))


def test_ordinal_probabilities():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, ordinal_quality.SIZE)) * 0.01
    x[:, 0] = rnd.normal(size=300)
    y = np.digitize(x[:, 0] * 3 + rnd.normal(size=300) * 0.3, [-1, 1])
    model = ordinal_quality.fit(x, y)
    nll = lambda w, cut: -np.log(np.maximum(np.diff(np.column_stack([np.zeros(300), 1 / (1 + np.exp(np.clip((x @ w)[:, None] - cut, -30, 30))), np.ones(300)]), axis=1)[np.arange(300), y], 1e-9)).mean() + ordinal_quality.RIDGE * (w @ w) / 2
    best = nll(model.weights, model.thresholds)
    assert all(nll(model.weights * k, model.thresholds + d) > best - 2e-2 for k in (0.9, 1.1) for d in (-0.1, 0.0, 0.1))
    text = "Some words, of MANY kinds."
    z = float(ordinal_quality.features(text) @ model.weights)
    assert np.allclose(model.tails(text), [1 / (1 + math.exp(t - z)) for t in model.thresholds])


def test_byte_bpe_through_spark(spark):
    ranks = byte_bpe.read_ranks(BYTE_BPE)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, "a" * 3_000]
    found = {r["doc_id"]: r for r in byte_bpe.digest_documents(_docs(spark, texts), BYTE_BPE, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = other.encode_ordinary(t or "")
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digest_documents(_docs(spark, ["x"]).limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_jpeg_transform_and_stored_tensors(spark):
    texts = [*TEXTS[:7], "some words " * 40]
    media = progressive_jpeg.write_media(_docs(spark, texts))
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    tensors = {r["doc_id"]: r for r in progressive_jpeg.read_tensors(media).collect()}
    found = {r["doc_id"]: r for r in progressive_jpeg.read_media(media).collect()}
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, math.sqrt(0.125), 0.5)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (found[i]["payload_bytes"], found[i]["payload_sha256"], found[i]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        image, parsed = progressive_jpeg.decode_many([files[i]])[0], progressive_jpeg.parse(files[i])
        assert files[i][:2] == b"\xff\xd8" and b"\xff\xc2" in files[i] and files[i][-2:] == b"\xff\xd9"
        planes = []
        for (_, h, v, q), coef in zip(parsed.components, image.coefficients):
            cols, rows = parsed.mcus[0] * h, parsed.mcus[1] * v
            plane = np.zeros((rows * 8, cols * 8))
            for k, own in enumerate(coef):
                block = np.zeros((8, 8))
                for z, p in enumerate(progressive_jpeg.ZIGZAG):
                    block[p // 8, p % 8] = float(own[z]) * float(np.asarray(parsed.quantisation[q]).reshape(-1)[z])
                r, c = divmod(k, cols)
                plane[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] = basis @ block @ basis.T + 128
            planes.append(np.clip(plane, 0, 255).repeat(2 // v, axis=0).repeat(2 // h, axis=1)[: image.height, : image.width])
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        plain = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
        rgb = np.frombuffer(tensors[i]["rgb"], dtype=np.uint8).reshape(tensors[i]["height"], tensors[i]["width"], 3)
        assert np.abs(plain - rgb).max() <= 3 and (rgb == image.rgb).all()


def test_quality_rules_equal_their_sql(spark, tmp_path):
    rnd = random.Random(3)
    texts = [*TEXTS, *("\n".join(" ".join(rnd.choice(["a", "b#", "LOUD", "word", "&"]) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 5))) for _ in range(60))]
    path = str(tmp_path / "documents.parquet")
    _docs(spark, texts).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for name, sql in queries.oracles().items():
        own, other = queries.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(sql).df()
        rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()), key=str)
        assert sorted(own.columns) == sorted(other.columns) and rows(own) == rows(other)
    docs = spark.read.parquet(path)
    kept = {r["doc_id"] for r in quality_rules.filter_documents(docs).collect()}
    assert kept == {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").collect()}
    base = quality_rules.apply_policy(quality_rules.ledger(docs), "base")
    assert base.where("kept = base_failed").count() == 0


def test_shingles_of_pieces():
    import pyarrow as pa

    import corridor.llm.shingling as shingling

    texts = ["A b\tc  d a B c D", None, "", " \x0b ", "one", "one two", "\x85a\xa0b c d", "x" * 5000 + " y z " + "w" * 300, "p q r s t " * 700]
    whole = shingle_sets(pa.array(texts), 3)
    piece, shingling.PIECE = shingling.PIECE, 64
    try:
        cut = shingle_sets(pa.array(texts), 3)
    finally:
        shingling.PIECE = piece
    sizes = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        words = [x for x in w.split(" ") if x]
        sizes.append(len({tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}) if words else 0)
    assert [len(s) for s in whole] == sizes and all((a == b).all() for a, b in zip(whole, cut))


def test_large_groups_of_copies(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    base = [rnd.choice(words) for _ in range(150)]
    texts = [" ".join(base)] * 40
    for k in range(150):  # near copies with 1 to 4 words of their own or taken out
        own = list(base)
        for _ in range(k % 4 + 1):
            at = rnd.randrange(len(own))
            own[at : at + 1] = [] if rnd.random() < 0.3 else [rnd.choice([f"own{k}", rnd.choice(words)])]
        texts.append(" ".join(own))
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(f"{rnd.choice(words)}" for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(_docs(spark, texts)).collect()}
    assert found == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
