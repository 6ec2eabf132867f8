"""Columns of wide reports packed into pages: a greedy fold, computed without folding.

A page takes columns in order while their widths fit, one at least. Where the next page would
start if one started at a given column needs only running widths and a search in them; which
columns do start a page follows by doubling those pointers, in rounds by the logarithm of the
number of columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.operators.ranges import running_sums
from corridor.session import materialise

#: Characters between columns.
GUTTER = 2


def packed(columns: DataFrame, rooms: DataFrame, key: str) -> DataFrame:
    """``key, pos, page``: the page, from 1, of each column (``pos, width``); ``room`` is what a page of the report holds. Columns of a report without a room are left out."""
    keys = [key]
    rows = columns.select(key, "pos", (F.col("width") + GUTTER).cast("long").alias("w")).join(rooms.select(key, "room"), key)
    one = rows.withColumn("one", F.lit(1).cast("long"))
    at = materialise(running_sums(one, keys, "pos", ["w", "one"]).select(key, "pos", "room", "w", F.col("w_upto").alias("end"), F.col("one_upto").alias("k")), "columns")
    # the last column that ends by where the page would: counted among all ends
    want = at.select(key, "k", (F.col("end") - F.col("w") + F.col("room")).alias("x"))
    points = at.select(key, F.col("end").alias("x"), F.lit(1).cast("long").alias("ends")).union(want.select(key, "x", F.lit(0).cast("long")))
    counted = running_sums(points.groupBy(key, "x").agg(F.sum("ends").alias("ends")), keys, "x", ["ends"])
    jump = want.join(counted.select(key, "x", "ends_upto"), [key, "x"]).select(key, "k", (F.greatest("ends_upto", "k") + 1).alias("next"))
    jump = materialise(jump, "jump")
    most = jump.agg(F.max("k")).first()[0] or 0  # one number
    starts = jump.where("k = 1").select(key, "k")
    for _ in range(max(0, math.ceil(math.log2(max(1, most))))):
        starts = materialise(starts.union(starts.join(jump, [key, "k"]).select(key, F.col("next").alias("k"))).distinct(), "starts")
        jump = materialise(jump.join(jump.select(key, F.col("k").alias("next"), F.col("next").alias("then")), [key, "next"], "left").where("then IS NOT NULL").select(key, "k", F.col("then").alias("next")), "jump")
        if jump.isEmpty():
            break
    flagged = at.select(key, "pos", "k").join(starts.withColumn("first", F.lit(1).cast("long")), [key, "k"], "left").select(key, "pos", F.coalesce("first", F.lit(0)).cast("long").alias("first"))
    return running_sums(flagged, keys, "pos", ["first"]).select(key, "pos", F.col("first_upto").alias("page"))
