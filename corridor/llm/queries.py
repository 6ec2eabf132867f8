"""The registered queries of the subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import (
    arrow_sequences,
    byte_bpe,
    fingerprints,
    language_id,
    lexical_search,
    merkle,
    ngram_jaccard,
    ordinal_quality,
    packing,
    pii,
    progressive_jpeg,
    quality_rules,
    toxicity,
)
from corridor.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
#: The setting that holds the secret key of pseudonyms; where it is unset a local master takes a public one, for tests, and a cluster draws one.
KEY_SETTING = "spark.corridor.pseudonymKey"
PSEUDONYM_KEY = b"corridor demonstration key"
_DRAWN: dict[str, bytes] = {}


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's key for pseudonyms. A cluster without one gets a random key that lasts as long as the application: who is to undo its pseudonyms later must keep what this returns."""
    found = spark.conf.get(KEY_SETTING, None)
    if found:
        return found.encode()
    if spark.sparkContext.master.startswith("local"):
        return PSEUDONYM_KEY
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from profiles of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_crc_mod(4) == 2, F.lit(False))
    profiles = language_id.train(docs.where(~held))
    return language_id.predict(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Arrow sequence files, read back."""
    return arrow_sequences.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a lexicon from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_crc_mod(3) == 1, F.lit(False))
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word shingle sets have a Jaccard index of 0.9 or more."""
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of all documents under the current policy."""
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and rejects alone, from the stored ledger of all documents."""
    return quality_rules.ablation(materialise(quality_rules.ledger(table(spark, sf_dir, "documents")), "quality-ledger"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data permuted within its format."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark)).select("doc_id", "text", "n_pii")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to byte-level tokens and decoded."""
    return byte_bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored in progressive JPEGs and read back."""
    return progressive_jpeg.read_media(progressive_jpeg.write_media(table(spark, sf_dir, "documents")))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 is poor, 1 sound but toxic, 2 good."""
    return labels.selectExpr("doc_id", "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END AS grade")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every document, from the ratings that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_crc_mod(5) == 0, F.lit(False))
    model = ordinal_quality.train(docs, graded(table(spark, sf_dir, "labels")).where(~held))
    found = ordinal_quality.score(docs, model)
    tail = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return found.select("doc_id", held.alias("held_out"), "expected_grade", tail.alias("score"), (tail >= 0.5).alias("kept"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, held against rows of which every fifth is tampered with."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.audit(merkle.build(merkle.leaves(docs, _crc_mod(5) == 0, text=lowered)))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-sample fingerprints of all documents and of their edited texts, compared."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item, from an index of all documents."""
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_arrow_sequences": op2_arrow_sequences,
        "op3_toxicity": op3_toxicity,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_quality_rules": op5_quality_rules,
        "quality_ablation": quality_ablation,
        "op6_packing": op6_packing,
        "op7_pii_pseudonyms": op7_pii_pseudonyms,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_progressive_jpeg": op9_progressive_jpeg,
        "op10_ordinal_quality": op10_ordinal_quality,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_fingerprints": op12_fingerprints,
        "op13_lexical_search": op13_lexical_search,
    }


def oracles() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.SQL, "quality_ablation": quality_rules.ABLATION_SQL, "op11_merkle_manifest": merkle.SQL, "op13_lexical_search": lexical_search.SQL}
