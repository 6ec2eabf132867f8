"""N-gram Jaccard join: classes of documents whose shingle sets are nearly equal.

Two sets link when ``100 * |A and B| >= PERCENT * |A or B|``. Every linked pair passes a prefix
filter under each global token order, so candidates are intersected over four orders before
any two sets are compared:

1. Order by hash. A set of ``n`` shingles needs a partner to share ``o = ceil(n * PERCENT / 100)``
   of them, so the first ``n - o + l`` shingles of both share at least ``l``. ``sketches`` makes
   that prefix. Equal sets are one class from there on. A class with fewer than ``l`` prefix
   shingles that another class's prefix has too has no partner and is done (``candidates``); of
   the others' whole sets, those with more than ``n - o`` shingles of their own (``searchable``).
2. Order by count among those sets, rarest first (``searches``). The first common shingle of a
   linked pair is among the first ``n - o + 1`` of both, and the shingles before it are not
   common: from its places ``i`` and ``j``, ``min(n - i, m - j)`` bounds the intersection. A set
   of a large group of copies whose own edits alone forbid a link gets no candidate there.
3. Orders by two multiplied hashes (``verify``): the prefixes of both must meet as well, before
   the pair's whole sets are fetched and intersected.

A bucket holds the sets that search by one shingle. Its sets are compared with a few pivots
first (those with the fewest rarer shingles: an original beats its edited copies), so a group of
near copies becomes one component by a number of comparisons linear in its size. What is still
in two components is then compared with the bucket's other sets, by equal bucket and a size at
which the bound of 2. can hold. Components come from rounds of label propagation with pointer
jumping. Nothing is capped: each pair that may link is compared or already in one component.

Defined results: null texts and texts without words have no shingle and stay alone; fewer
words than a shingle's make one shingle; very long texts are hashed in pieces and compared
whole; repeated rows and equal ids fall together where their texts do; rows with a null id take
part, and a component of them alone has a null id; of ties the smallest id names a component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.llm.shingling import mix, shingle_sets, slices
from corridor.session import materialise

WORDS = 3
PERCENT = 90
#: Shared prefix shingles that are asked for: so many, or so many hundredths of a larger set.
LEAST_SHARED, SHARED_PERCENT = 24, 5
#: Pivots of a bucket.
PIVOTS = 3
#: Multipliers (odd 64-bit numbers) of the global orders besides the hash's own.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows that agree in these are one class.
KEY = ["n", "sig1", "sig2"]


def shared_needed(n: int, percent: int = PERCENT) -> int:
    """How many shingles a set of ``n`` shares with any partner, at least."""
    return -(-n * percent // 100)


def _asked(n: int, percent: int) -> int:
    """Shared shingles that ``sketches`` lets a set's prefix hold; it never falls as ``n`` grows."""
    return max(1, min(shared_needed(n, percent), max(LEAST_SHARED, n * SHARED_PERCENT // 100)))


def _needed_sql(n: str, percent: int) -> str:
    return f"((({n}) * {percent} + 99) div 100)"


def _asked_sql(n: str, percent: int) -> str:
    return f"greatest(1L, least({_needed_sql(n, percent)}, greatest({LEAST_SHARED}L, ({n}) * {SHARED_PERCENT} div 100)))"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits a set that equal sets share, as two signed columns."""
    out = np.zeros((len(sets), 2), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        begins = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for k, values in enumerate((flat, flat * np.uint64(ORDERS[0]))):
            out[full, k] = np.add.reduceat(mix(values), begins)
    return out.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, sig1, sig2, prefix``: one row a document, from its whole text.

    ``prefix`` holds the first shingles under the hash's own order. Equal signatures and
    sizes mean equal sets.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = shingle_sets(batch.column(1), size)
            sig = signatures(sets)
            prefixes = [s[: len(s) - shared_needed(len(s), percent) + _asked(len(s), percent)] for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *KEY, "prefix"])

    kind = f"doc_id {id_type}, n long, sig1 long, sig2 long, prefix array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _own_counts(tokens: DataFrame) -> DataFrame:
    """``v, own``: how many of a class's shingles (``v, token``) no other class has. Repeated rows count once."""
    ends = tokens.groupBy("token").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    return ends.where("v = last").groupBy("v").agg(F.count("*").alias("own"))


def candidates(classes: DataFrame, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The classes (``v, doc_id, n``) that may have a partner, from the prefixes of all ``docs``.

    A class that shares fewer of its prefix shingles than the asked number is alone.
    """
    tokens = sketches(docs, size, percent).select(F.col("sig1").alias("v"), F.explode("prefix").alias("token"))
    asked = _asked_sql("n", percent)
    least = _asked_sql(f"n * {percent} div 100", percent)  # no partner is smaller than that
    found = classes.join(_own_counts(tokens), "v", "left")
    return found.where(f"n - {_needed_sql('n', percent)} + {asked} - coalesce(own, 0L) >= {least}").select("v", "doc_id", "n")


def _texts_of(found: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``v, text``: one text of each class.

    It is one with the class's id whose signature is the class's (an id may stand for several
    texts); a class without an id is found among the texts without one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sig = pa.array(signatures(shingle_sets(batch.column(1), size))[:, 0])
            wanted = batch.column(0)
            own = pc.fill_null(pc.equal(wanted, sig), True)
            yield pa.RecordBatch.from_arrays([sig, batch.column(1)], ["v", "text"]).filter(own)

    kind = "v long, text string"
    # the classes grow with the documents: joined by a shuffle at every size
    named = docs.join(found.where("doc_id IS NOT NULL").select("v", "doc_id").hint("merge"), "doc_id").select("v", "text")
    bare = docs.where("doc_id IS NULL AND text IS NOT NULL").select(F.lit(None).cast("long").alias("v"), "text")
    bare = bare.mapInArrow(run, kind).join(found.where("doc_id IS NULL").select("v"), "v", "left_semi")
    return named.mapInArrow(run, kind).union(bare).dropDuplicates(["v"])


def whole_sets(texts: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``v, n, own_set, second, third`` of ``texts`` (``v, text``): a set and its prefixes under two more orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = shingle_sets(batch.column(1), size)
            keeps = [len(s) - shared_needed(len(s), percent) + 1 for s in sets]
            turned = [[np.sort(s * np.uint64(k))[:keep] for s, keep in zip(sets, keeps)] for k in ORDERS]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), *map(_lists, turned)]
            yield pa.RecordBatch.from_arrays(columns, ["v", "n", "own_set", "second", "third"])

    return texts.select("v", "text").mapInArrow(run, "v long, n long, own_set array<long>, second array<long>, third array<long>")


def searchable(found: DataFrame, texts: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The classes of ``found`` whose whole sets hold few enough shingles of their own for a link."""
    own = _own_counts(whole_sets(texts, size, percent).select("v", F.explode("own_set").alias("token")))
    return found.join(own, "v", "left").where(f"coalesce(own, 0L) <= n - {_needed_sql('n', percent)}").select("v", "doc_id", "n")


def searches(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``v, n, i, token``: the shingles by which each set (``v, n, own_set``) is searched, rarest first.

    ``i`` is the shingle's place in the set's order by count.
    """
    exploded = sets.select("v", "n", F.explode("own_set").alias("token"))
    counts = exploded.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = exploded.join(counts, "token").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("s"))
    # shingles that no other set has come first; `take` of the shared ones end the prefix
    rows = shared.selectExpr("v", "n", "s", "n - size(s) AS own").withColumn("take", F.expr(f"n - {_needed_sql('n', percent)} + 1 - own"))
    rows = rows.where("take > 0").select("v", "n", "own", F.expr("slice(s, 1, cast(least(take, size(s)) AS int))").alias("s"))
    return rows.select("v", "n", "own", F.posexplode("s").alias("at", "x")).selectExpr("v", "n", "own + at AS i", "x.token AS token")


def _may_link(percent: int, reach: str, sizes: str) -> str:
    """A bound of the intersection that is too small for a link of sets with these sizes in sum fails."""
    return f"({100 + percent} * ({reach}) >= {percent} * ({sizes}))"


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a, b``) whose sets link.

    Their prefixes under the further orders must meet before the whole sets are fetched.
    """

    def sides(rows: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(sets.select(F.col("v").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)
        return rows

    met = sides(pairs, "second", "third").where("arrays_overlap(a_second, b_second) AND arrays_overlap(a_third, b_third)").select("a", "b")
    common = "size(array_intersect(a_own_set, b_own_set))"
    return sides(met, "n", "own_set").where(_may_link(percent, common, "a_n + b_n")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``v, comp``: the smallest vertex that each vertex of ``edges`` (``a, b``) reaches."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("v").agg(F.least("v", F.min("u")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        step = lower.join(jump, "low", "left").select("v", F.coalesce("far", "low").alias("comp"), "was")
        step = materialise(step, "labels")
        moved = step.where("comp <> was").limit(1).count()
        labels = step.select("v", "comp")
        if not moved:
            return labels


def link_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``v, comp`` of the sets that link with another one."""
    buckets = materialise(searches(sets, percent), "buckets")
    # a shingle that one set alone searches by finds nobody
    best = [F.min(F.when(F.pmod("v", F.lit(PIVOTS)) == k, F.struct("i", "v", "n"))).alias(f"p{k}") for k in range(PIVOTS)]
    alive = buckets.groupBy("token").agg(F.count("*").alias("members"), *best).where("members > 1")
    pivots = materialise(alive.select("token", F.array_compact(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("p")), "pivots")
    star = buckets.join(pivots, "token").select("v", "n", "i", F.explode("p").alias("q")).where(_may_link(percent, "least(n - i, q.n - q.i)", "n + q.n"))
    first = materialise(verify(_distinct_pairs(star.selectExpr("v AS a", "q.v AS b")), sets, percent), "links")
    named = components(first)

    # of the buckets with more than one component, the sets outside the largest one search on
    spread = buckets.join(pivots.select("token"), "token").join(named, "v", "left").select("token", "v", "n", "i", F.coalesce("comp", "v").alias("comp"))
    spread = materialise(spread, "spread")
    sizes = spread.groupBy("token", "comp").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("big"), F.count("*").alias("parts")).where("parts > 1")
    open_ = spread.join(largest.select("token", F.col("big.comp").alias("big")), "token")
    by_size = open_.groupBy("token", F.col("n").alias("m")).agg(F.max(F.col("n") - F.col("i")).alias("reach"))
    few = open_.where("comp <> big").select("token", F.col("v").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("comp").alias("ca"))
    few = few.join(by_size, "token").where(_may_link(percent, "least(na - ia, reach)", "na + m")).drop("reach")
    all_ = open_.select("token", F.col("v").alias("b"), F.col("n").alias("m"), F.col("i").alias("ib"), F.col("comp").alias("cb"))
    cross = few.join(all_, ["token", "m"]).where(F.col("ca") != F.col("cb")).where(_may_link(percent, "least(na - ia, m - ib)", "na + m"))
    second = materialise(verify(_distinct_pairs(cross), sets, percent), "links")
    if second.limit(1).count() == 0:
        return named
    return components(first.union(second))


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' classes (``doc_id, n, sig1, sig2``), and ``n, sig1, sig2, doc_id, comp`` of every class: its smallest id and its component."""
    docs = docs.select("doc_id", "text")
    rows = materialise(sketches(docs, size, percent).drop("prefix"), "sketches")
    classes = materialise(rows.where("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id")).withColumn("v", F.col("sig1")), "classes")
    found = materialise(candidates(classes.dropDuplicates(["v"]), docs, size, percent), "candidates")
    texts = materialise(_texts_of(found, docs, size), "texts")
    found = materialise(searchable(found, texts, size, percent), "searchable")
    sets = materialise(whole_sets(texts.join(found.select("v"), "v", "left_semi"), size, percent), "sets")
    linked = link_classes(sets, percent)
    named = classes.join(linked, "v", "left").select(*KEY, "doc_id", F.coalesce("comp", "v").alias("comp"))
    return rows, materialise(named, "named")


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    rows, named = _classes(docs, size, percent)
    lowest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "comp").select(*KEY, "component_id")
    out = rows.select("doc_id", *KEY).join(named, KEY, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _free_mark(columns: list[str]) -> str:
    """The beginning of names that no column has."""
    mark = "class_"
    while any(c.lower().startswith(mark) for c in columns):
        mark = "_" + mark
    return mark


def _signed(docs: DataFrame, size: int, mark: str) -> DataFrame:
    """``docs`` with each row's own class, in columns that begin with ``mark``."""
    at = docs.columns.index("text")
    kind = T.StructType([*docs.schema.fields, *(T.StructField(f"{mark}{k}", T.LongType()) for k in KEY)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            sets = shingle_sets(batch.column(at), size)
            sig = signatures(sets)
            columns = [*batch.columns, pa.array([len(own) for own in sets], pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(f"{mark}{k}" for k in KEY)])

    return docs.mapInArrow(run, kind)


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns.

    It is a row with the smallest id, one without an id only where no row has one; of several
    with that id the class with the smallest signature and then the smallest row hash decide.
    Rows without a shingle stay, equal texts under one id once.
    """
    mark = _free_mark(docs.columns)
    rows, named = _classes(docs, size, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sig1", "sig2", "n")).alias("c")
    chosen = materialise(named.groupBy("comp").agg(least).select("c.doc_id", "c.sig1", "c.sig2", "c.n"), "chosen")
    ids = materialise(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k"), F.max("n").alias("n")), "ids")
    # an id of one row names its class
    lone = ids.where("k = 1")
    kept = lone.where("n = 0").select("doc_id").union(lone.join(chosen, "doc_id", "left_semi").select("doc_id"))
    one = docs.join(kept.distinct().hint("merge"), "doc_id", "left_semi").select(*docs.columns)  # ids grow with the documents
    # rows of other ids and without one are told apart by their own texts
    many = docs.join(ids.where("k > 1"), "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))
    many = materialise(_signed(many, size, mark), "repeated")
    own = [many[f"{mark}{k}"] == chosen[k] for k in KEY]
    found = many.join(chosen, [many["doc_id"].eqNullSafe(chosen["doc_id"]), *own], "left_semi")
    bare = many.where(f"{mark}n = 0")
    order = F.xxhash64(*docs.columns)
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), order).alias("r")).select("r.*")
    return one.union(first(found, "doc_id", *(f"{mark}{k}" for k in KEY))).union(first(bare.where("doc_id IS NOT NULL"), "doc_id", "text")).union(bare.where("doc_id IS NULL").select(*docs.columns))
