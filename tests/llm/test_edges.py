"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns for every operator."""

import public_tokenizers
import pytest

from corridor.llm import arrow_sequences, byte_bpe, language_id, ngram_jaccard, ordinal_quality, packing, pii, progressive_jpeg, quality_rules, toxicity

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "Lorem 4111 1111 1111 1111 ipsum idiot dolor " * 8_000
ROWS = [(1, None), (2, ""), (3, LONG), (4, "one two"), (4, "one two"), (None, "no id"), (None, None), (5, " \n\t ")]
LEXICON = toxicity.Lexicon({"idiot": 4.0}, ("idiot proof",), -1.0, 1.0, 0.5, True)
MODEL = ordinal_quality.Ordinal(ordinal_quality.np.linspace(-1, 1, ordinal_quality.SIZE), ordinal_quality.np.array([-0.5, 0.5]), [0, 1, 2])

OPERATORS = {
    "language": lambda d: language_id.predict(d, {"aa": [ord("o"), ord("e")], "bb": [ord("x")]}),
    "sequences": lambda d: arrow_sequences.round_trip(d, WORD_BPE),
    "toxicity": lambda d: toxicity.score(d, LEXICON),
    "toxicity_filter": lambda d: toxicity.filter_documents(d, LEXICON),
    "jaccard": ngram_jaccard.join,
    "quality": lambda d: quality_rules.apply_policy(quality_rules.ledger(d)),
    "packing": lambda d: packing.pack_documents(d, WORD_BPE),
    "pii": lambda d: pii.pseudonymise(d, b"k"),
    "byte_bpe": lambda d: byte_bpe.digest_documents(d, BYTE_BPE, public_tokenizers.PATTERN),
    "jpeg": lambda d: progressive_jpeg.read_media(progressive_jpeg.write_media(d)),
    "ordinal": lambda d: ordinal_quality.score(d, MODEL),
}
#: Names that results or inner steps use.
CLASH = ["score", "predicted", "n_pii", "pii", "tails", "expected_grade", "v", "n", "sig1", "token", "lang_pred", "bits", "kept", "media", "ids", "length", "start", "corridor_class_n"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    return plain, plain.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASH))


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(docs, name):
    plain, clashing = docs
    run = OPERATORS[name]
    found, other = run(plain), run(clashing)
    own = [c for c in found.columns if c != "pii"]
    rows = lambda df: sorted(map(str, df.select(*own).collect()))
    assert rows(found) == rows(other)
    n = found.count()
    assert n == len(ROWS) - (name == "toxicity_filter") if name != "packing" else n >= len(ROWS)
    assert run(plain.limit(0)).count() == 0 and run(clashing.limit(0)).count() == 0
    again = [tuple(r) for r in found.where("doc_id = 4").select(*(c for c in own if c not in ("start", "sequence_id", "offset", "ids_path"))).collect()]
    assert len(again) == 2 and again[0] == again[1]


def test_keep_one_with_clashing_columns(docs):
    plain, clashing = docs
    kept = ngram_jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, ngram_jaccard.keep_one(plain).collect()))
