"""Quality rules as a bitmask ledger, in DataFrame functions alone.

``ledger`` evaluates every rule once per document and stores its measurements and
one failure bit per rule. ``apply_policy`` turns stored bits into verdicts under a
named policy version, and ``ablation`` counts, from the bits alone, what each rule
of a policy rejects and what it alone rejects. Changing a policy never rereads text.

Defined results: a null or empty text has no word and fails ``few_words``; repeated
rows are judged alike, each on its own; columns other than ``doc_id`` and ``text``
are ignored, so clashing names do no harm; very long texts are measured whole; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, and the symbol characters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``sql``, over the measurements, is true."""

    bit: int
    name: str
    sql: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "dup_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(5, "shouting", "2 * n_upper > word_chars"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": BASE,
    "v1": tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of every whole text.

    ``n_repeat_words`` counts the words that lie in a 3-word window found twice or
    more in the text, the first occurrence included, each word once. Windows are
    hashed; only a text whose hashes repeat is sorted, so the cost stays n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    trimmed = F.btrim(text, F.lit(SPACE))
    base = docs.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1)).alias("w"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    counted = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        F.expr(
            "CASE WHEN size(w) < 3 THEN cast(array() AS array<bigint>) "
            "ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"
        ).alias("h"),
    )
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper"]
    ordered = counted.select(
        *keep,
        F.expr(
            "CASE WHEN size(array_distinct(h)) < size(h) "
            "THEN sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))) END"
        ).alias("s"),
    )
    placed = ordered.select(
        *keep,
        F.expr(
            "CASE WHEN s IS NOT NULL THEN sort_array(transform("
            "filter(s, (e, j) -> (j > 0 AND s[greatest(j - 1, 0)].x = e.x) "
            "OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = e.x)), e -> e.i)) END"
        ).alias("p"),
    )
    return placed.select(
        *keep,
        F.expr(
            "CASE WHEN p IS NULL THEN 0L ELSE aggregate(transform(p, (v, j) -> "
            "CASE WHEN j = size(p) - 1 THEN 3 ELSE least(3, p[least(j + 1, size(p) - 1)] - v) END), "
            "0L, (a, b) -> a + b) END"
        ).alias("n_repeat_words"),
    )


def failure_bits() -> Column:
    """The failure bits of a row of measurements."""
    bits = F.lit(0)
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the measurements and ``bits``."""
    # the row number (never below 0) keeps filters on verdicts above the measurements: pushed below, their text would grow with each use
    no_bit = F.when(F.monotonically_increasing_id() < 0, F.lit(1)).otherwise(F.lit(0))
    return measure(docs).select("doc_id", *MEASURES, failure_bits().bitwiseOR(no_bit).alias("bits"))


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under the named policy."""
    return rows.withColumns(
        {
            "base_failed": F.col("bits").bitwiseAND(mask(BASE)) != 0,
            "kept": F.col("bits").bitwiseAND(mask(POLICIES[version]) | mask(BASE)) == 0,
        }
    )


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those no other rule of the policy rejects.

    The ledger is first counted by its bits (2^rules groups at most), so this costs one
    small shuffle whatever the number of documents.
    """
    spark = rows.sparkSession
    within = mask(POLICIES[version])
    counts = rows.groupBy(F.col("bits").bitwiseAND(within).alias("bits")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame(
        [(r.name, 1 << r.bit) for r in RULES if r.name in POLICIES[version]], "rule string, rule_bit int"
    )
    hit = F.col("bits").bitwiseAND(F.col("rule_bit")) != 0
    return (
        rules.join(counts, hit, "left")
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("rule_bit"), F.col("n"))), F.lit(0)).cast("long").alias("n_only"),
        )
    )


def filter_documents(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The documents a policy keeps, with all their columns.

    The verdict is computed beside the row from the row itself: no join, no shuffle.
    """
    packed = docs.select(F.struct("*").alias("doc_id"), F.col("text"))  # the whole row rides as the id
    judged = apply_policy(ledger(packed), version)
    return judged.where("kept").select("doc_id.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c >= 2) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_upper,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
        + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END AS INTEGER) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits = 0 AS kept, bits FROM b
"""
#: What each rule of the current policy rejects, and rejects alone.
ABLATION_SQL = (
    SQL.replace("WITH d AS", "WITH ledger AS (WITH d AS", 1).rstrip()
    + """), rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('dup_lines', 8), ('word_length', 16), ('shouting', 32)) AS r (rule, bit))
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only FROM rules LEFT JOIN ledger ON true GROUP BY rule
"""
)
