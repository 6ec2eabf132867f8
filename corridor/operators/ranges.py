"""Ordered computations without a sort of the whole table in one task: rows are cut into ranges.

A range's own order is a window of its own; what crosses ranges (sums before, the next first
row) comes from a table of one small row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.session import materialise

BINS = 1024


def binned(rows: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """``rows`` with ``_bin``: equal steps between the least and the greatest value of the row's group."""
    ends = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))  # one row a group
    both = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))
    step = F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    return both.withColumn("_bin", F.coalesce(F.least(step, F.lit(bins - 1)), F.lit(0)).cast("int")).drop("_lo", "_hi")


def running_sums(rows: DataFrame, keys: list[str], value: str, sums: list[str], bins: int = BINS) -> DataFrame:
    """``rows`` (one a value) with ``<sum>_upto`` for each of ``sums``: its running sum by ``value`` within ``keys``."""
    cut = binned(rows, keys, value, bins)
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # over `bins` rows a group
    shifts = cut.groupBy(*keys, "_bin").agg(*(F.sum(s).alias(s) for s in sums))
    shifts = shifts.select(*keys, "_bin", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in sums))
    own = W.partitionBy(*keys, "_bin").orderBy(value)
    inner = cut.withColumns({f"{s}_upto": F.sum(s).over(own) for s in sums}).join(shifts, [*keys, "_bin"])
    return inner.select(*rows.columns, *((F.col(f"{s}_upto") + F.col(f"_{s}")).alias(f"{s}_upto") for s in sums))


def value_at(counts: DataFrame, keys: list[str], value: str, weight: str, index: Column | str, levels: int = 2, bins: int = BINS) -> DataFrame:
    """``keys, n, value`` of each group: its weight, and the value that holds the ``index``-th unit of it.

    ``index`` is an expression of ``n``, or names a column of ``counts`` that is alike in a group.

    ``counts`` (one row a value) is written once. A level is one sum over it: of the group's
    range of values, cut into equal steps, the step that holds the index is the next range, as
    narrow as its values. What is left after the levels alone is sorted.
    """
    named = isinstance(index, str)
    own = F.col(index).cast("long") if named else F.lit(None).cast("long")
    rows = materialise(counts.select(*keys, F.col(value).alias("_x"), F.col(weight).cast("long").alias("_w"), own.alias("_given")), "counts")
    state = rows.groupBy(*keys).agg(F.sum("_w").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.first("_given").alias("_given")).where("n > 0")
    state = state.withColumn("_at", F.col("_given") if named else index.cast("long")).drop("_given")
    rows = rows.drop("_given")
    by = W.partitionBy(*keys)

    def held() -> DataFrame:
        both = rows.join(state, keys) if keys else rows.crossJoin(F.broadcast(state))  # one row
        return both.where("_x BETWEEN _lo AND _hi")

    for _ in range(levels):
        step = F.floor(F.try_divide(F.col("_x").cast("double") - F.col("_lo"), F.col("_hi").cast("double") - F.col("_lo")) * bins)
        cut = held().withColumn("_bin", F.coalesce(F.least(step, F.lit(bins - 1)), F.lit(0)).cast("int"))
        sums = cut.groupBy(*keys, "n", "_at", "_bin").agg(F.sum("_w").alias("_w"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = sums.withColumn("_upto", F.sum("_w").over(by.orderBy("_bin")))  # at most `bins` rows a group
        state = materialise(upto.where("_upto > _at AND _upto - _w <= _at").select(*keys, "n", "_lo", "_hi", (F.col("_at") - F.col("_upto") + F.col("_w")).alias("_at")), "held")
    last = held().withColumn("_upto", F.sum("_w").over(by.orderBy("_x")))
    return last.where("_upto > _at AND _upto - _w <= _at").select(*keys, "n", F.col("_x").alias(value))


def with_next(rows: DataFrame, value: str, order: list[str], of: Column, name: str = "next") -> DataFrame:
    """``rows`` with ``value`` of the row behind it in ``order``, over the whole table; ``of`` names a row's range and rises with the order."""
    cut = rows.withColumn("_range", of)
    firsts = cut.groupBy("_range").agg(F.min(F.struct(*order, F.col(value).alias("_value")))["_value"].alias("_first"))
    after = firsts.select("_range", F.lead("_first").over(W.orderBy("_range")).alias("_after"))  # one row a range
    own = W.partitionBy("_range").orderBy(*order)
    inner = cut.withColumns({"_own": F.lead(value).over(own), "_last": F.lead(F.lit(True)).over(own).isNull()}).join(after, "_range")
    return inner.select(*rows.columns, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_own")).alias(name))


def numbered(rows: DataFrame, order: list[str], of: Column, name: str) -> DataFrame:
    """``rows`` with their place in ``order`` from 0, over the whole table; ``of`` names a row's range and rises with the order."""
    cut = rows.withColumn("_range", of)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    shift = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = W.partitionBy("_range").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(own) - 1)
    # null ranges come first, as null keys do
    joined = ranked.join(shift.withColumnRenamed("_range", "_r"), ranked["_range"].eqNullSafe(F.col("_r")))
    return joined.select(*rows.columns, (F.col("_rank") + F.col("_shift")).cast("long").alias(name))


def dense(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in ``order`` from 0, over the whole table; written once, in ranges of equal size whatever the values."""
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialise(kept, "dense").withColumn("_part", F.shiftright("_at", 33))
    stats = kept.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = stats.select("_part", (before - F.col("_first")).alias("_shift"))  # one row a partition
    return kept.join(F.broadcast(shifts), "_part").select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
