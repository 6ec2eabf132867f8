"""A corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
The key of the pseudonyms is the session's ``spark.corridor.pseudonymKey``, or one drawn for the application on a cluster without it.

Null and empty texts have no words: the base rules reject them in the first stage. Repeated rows
are judged alike, and one row of a component of near copies stays (``ngram_jaccard.keep_one`` has
the order). Very long texts go through every stage whole. Other columns than ``doc_id`` and
``text`` stay as they are, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import ngram_jaccard, packing, pii, quality_rules, toxicity
from corridor.llm.queries import WORD_BPE, pseudonym_key
from corridor.session import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality_rules.filter_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of toxicity, by a lexicon from all labels of what is left."""
    return toxicity.filter_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, pseudonym_key(spark), finds=False)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into windows."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("pii_pseudonyms", personal_data),
    ("packing", packed),
]

#: SQL can't express the lexicon's training or the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
