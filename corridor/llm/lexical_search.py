"""Ranked lexical search over a term-bucketed table of postings.

``build`` counts the terms of whole texts and writes an inverted index as a table bucketed by
term: a row holds one term's documents within a block (what a task read, up to
``BLOCK_POSTINGS``), as places in the block's list of ids. ``search`` joins the terms of the
items to it without a shuffle of the index, so only postings that an item asks for go on;
they are dealt by block, scored in whole numbers, summed by item and document inside the
block, cut to the block's best by row numbers, and ranked over all blocks.

A frequent term has a row a block, dealt to ``SALTS`` buckets; the items' side repeats its few
rows for each. Items that share a term travel in lists of about ``ITEMS_PER_LIST``. So neither
a term of all documents nor one of all items makes a row or a group that grows with the
input, and matches are made within their block alone.

Weights: ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` in doubles; ``m = 100 - 50 + (50 n N) div L``;
an item's score is the sum of ``w * (10^9 tf div (1000 tf + 20 m))`` over its terms, once each.

Defined results: a null or empty text has no term, is not counted and never found; an item
without terms finds nothing; rows of documents are documents of their own, also with equal or
null ids (a null id ranks before others of its score); rows with an equal item id are one
item with the terms of all, a null item id included; empty tables give an empty result; other
columns are ignored. Terms are kept as strings; 64-bit hashes tell them apart within a block
alone. The index stays in the session's catalogue and the shared folder until it is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.llm.shingling import slices
from corridor.llm.terms import NOT_ALNUM, count_terms
from corridor.session import materialise, shared_dir, shuffles_cleaned

#: Fixed value: a term is a run outside these characters of ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Postings and documents of a block at most, but for the slice that fills it; rows of an output batch.
BLOCK_POSTINGS = 1_000_000
BLOCK_DOCS = 100_000
ROWS_PER_BATCH = 20_000
#: Buckets that one term's blocks are dealt to, and the usual number of items in a list.
SALTS = 8
ITEMS_PER_LIST = 256
K = 50


class _Block:
    """The postings of one block, by term."""

    def __init__(self) -> None:
        self.names: dict[int, str] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[pa.Array] = []
        self.n = self.n_rows = self.n_docs = self.n_terms = 0

    def add(self, batch: pa.RecordBatch) -> None:
        found = count_terms(batch.column(1), NOT_ALNUM)
        lengths = np.bincount(found.text, weights=found.count, minlength=batch.num_rows).astype(np.int64)
        terms, firsts = np.unique(found.term, return_index=True)
        for term, i in zip(terms.tolist(), firsts.tolist()):
            if term not in self.names:
                self.names[term] = found.name(i)
        self.parts.append((found.term, found.text + self.n_rows, found.count, lengths[found.text]))
        self.ids.append(batch.column(0))
        self.n += len(found.term)
        self.n_rows += batch.num_rows
        self.n_docs += int(np.count_nonzero(lengths))
        self.n_terms += int(lengths.sum())

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The block's ids in order and its totals, then a row a term; places follow the order of ids."""
        ids = pa.concat_arrays(self.ids)
        by_id = pc.array_sort_indices(ids, null_placement="at_start")
        place = np.empty(len(ids), dtype=np.int32)
        place[by_id.to_numpy()] = np.arange(len(ids), dtype=np.int32)
        ids = ids.take(by_id)
        numbers = pa.list_(pa.int32())
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        empty = [pa.nulls(1, t) for t in (pa.string(), numbers, numbers, numbers)]
        yield pa.RecordBatch.from_arrays([pa.array([block]), empty[0], whole, *empty[1:], pa.array([self.n_docs]), pa.array([self.n_terms])], _COLUMNS)
        term, doc, tf, length = (np.concatenate(x) for x in zip(*self.parts))
        at = place[doc]
        order = np.lexsort((at, term))
        term = term[order]
        bounds = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else np.zeros(1, dtype=np.int64)
        values = [pa.array(x[order].astype(np.int32)) for x in (at, tf, length)]
        for begin in range(0, len(bounds) - 1, ROWS_PER_BATCH):
            cut = bounds[begin : begin + ROWS_PER_BATCH + 1]
            n = len(cut) - 1
            offsets = pa.array((cut - cut[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, v.slice(cut[0], cut[-1] - cut[0])) for v in values]
            names = pa.array([self.names[t] for t in term[cut[:-1]].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), names, pa.nulls(n, whole.type), *lists, pa.array(np.diff(cut)), pa.nulls(n, pa.int64())], _COLUMNS)


_COLUMNS = ["block", "term", "ids", "places", "tfs", "lengths", "df", "n_terms"]


def postings(docs: DataFrame, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """A row for each term of a block (``places, tfs, lengths`` of its documents, ``df`` of them), and one with a null term: its ``ids``, its documents with terms as ``df``, and ``n_terms``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1):
                for at in range(0, part.num_rows, BLOCK_DOCS):
                    own.add(part.slice(at, BLOCK_DOCS))
                    if own.n >= block_postings or own.n_rows >= BLOCK_DOCS:
                        yield from own.rows(number)
                        own, number = _Block(), number + 1
        if own.n_rows:
            yield from own.rows(number)

    kind = f"block long, term string, ids array<{id_type}>, places array<int>, tfs array<int>, lengths array<int>, df long, n_terms long"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def build(docs: DataFrame, n_buckets: int | None = None, salts: int = SALTS, block_postings: int = BLOCK_POSTINGS) -> str:
    """Write the index of all documents to the shared folder; returns the table's name. ``search`` wants the same ``salts``."""
    spark = docs.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"corridor_postings_{uuid.uuid4().hex}"
    rows = postings(docs, block_postings).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    with shuffles_cleaned(spark):
        rows.repartition(n_buckets, "term", "salt").write.bucketBy(n_buckets, "term", "salt").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of each item's whole text."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # other letters stay as they are
    found = F.regexp_extract_all(low, F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def search(index: str, items: DataFrame, k: int = K, salts: int = SALTS, items_per_list: int = ITEMS_PER_LIST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of the index for each item."""
    table = items.sparkSession.table(index)
    real = table.where("term IS NOT NULL")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    asked = materialise(item_terms(items), "search-terms")
    n_lists = max(1, -(-asked.select("item_id").distinct().count() // items_per_list))

    words = asked.select("term").distinct().select("term", every_salt)
    df = real.select("term", "salt", "df").join(words.hint("shuffle_hash"), ["term", "salt"]).groupBy("term").agg(F.sum("df").alias("df"))
    totals = table.where("term IS NULL").agg(F.sum("df").alias("N"), F.sum("n_terms").alias("L"))  # one row
    weight = F.floor(F.log((2 * F.col("N") + 2).cast("double") / (2 * F.col("df") + 1)) * 1000).cast("long")
    weights = df.crossJoin(F.broadcast(totals)).select("term", weight.alias("w"), "N", "L")
    lists = asked.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(n_lists)).alias("list")).agg(F.collect_list(F.struct("item_id")).alias("items"))
    lists = materialise(lists.join(weights, "term").select("term", "w", "N", "L", "items"), "search-lists")

    hits = real.select("term", "salt", "block", "places", "tfs", "lengths").join(lists.select("*", every_salt).hint("shuffle_hash"), ["term", "salt"])
    hits = hits.select("block", "w", "N", "L", "items", "places", "tfs", "lengths").repartition("block")
    each = hits.select("block", "w", "N", "L", "items", "tfs", "lengths", F.posexplode("places").alias("i", "place"))
    each = each.select("block", "w", "N", "L", "items", "place", F.expr("CAST(tfs[i] AS BIGINT)").alias("tf"), F.expr("100 - 50 + (50 * CAST(lengths[i] AS BIGINT) * N) div L").alias("m"))
    each = each.select("block", "place", F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))").alias("part"), F.explode("items").alias("item"))
    scores = each.groupBy("block", "item.item_id", "place").agg(F.sum("part").alias("score")).where("score > 0")
    # dealt by block already: no block gives more than its k best
    first = W.partitionBy("block", "item_id").orderBy(F.desc("score"), "place")
    best = scores.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank")
    ids = table.where("term IS NULL").select("block", F.posexplode("ids").alias("place", "doc_id"))
    found = best.join(ids, ["block", "place"])
    last = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The ranking over the tables ``documents`` and ``benchmark``.
SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
  lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
  totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lens),
  asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, nn),
  scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lens USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
