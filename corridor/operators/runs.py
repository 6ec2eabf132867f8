"""Runs of states with one way in and one way out: each becomes one arc, by pointers of pointers.

A long road costs a search one step then, and the steps along it are looked up at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.session import materialise


class Arcs(NamedTuple):
    """``arcs``: ``arc, a, b, weight, run`` (null: a single move), numbered in the order in which a state's moves are tried; ``inner``: ``state, run, step``; ``steps``: ``arc, step, name``."""

    arcs: DataFrame
    inner: DataFrame
    steps: DataFrame


def _pointers(marked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``state, run, ahead``: the last state of each inner one's run and the moves to it; and the states of closed rings, which have no such, None where there are none."""
    step = marked.where("a_inner").select(F.col("a").alias("state"), F.when(F.col("b_inner"), F.col("b")).otherwise(F.col("a")).alias("at"), F.col("b_inner").cast("long").alias("ahead"))
    done, left = step.where("ahead = 0").selectExpr("state", "at AS run", "ahead"), step.where("ahead = 1")
    done, left = materialise(done, "runs"), materialise(left, "pointers")
    open_, before = left.count(), None
    while open_ and open_ != before:
        further = left.selectExpr("state AS at", "at AS then", "ahead AS more")
        ended = done.selectExpr("state AS at", "run", "ahead AS rest")
        both = left.join(further.hint("merge"), "at", "left").join(ended.hint("merge"), "at", "left")
        both = materialise(both.selectExpr("state", "then", "run", "ahead + coalesce(rest, more) AS ahead"), "pointers")
        done = done.union(both.where("run IS NOT NULL").select("state", "run", "ahead"))
        left = both.where("run IS NULL").selectExpr("state", "then AS at", "ahead")
        open_, before = left.count(), open_
    return materialise(done, "runs"), left.select("state") if open_ else None


def contracted(moves: DataFrame) -> Arcs:
    """The arcs of ``moves`` (``a, b, pos, to``: states, the order of a state's moves, the name of the second one). Closed rings stay as they are."""
    ends = moves.select(F.col("a").alias("state"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(moves.select("b", F.lit(0), F.lit(1)))
    plain = materialise(ends.groupBy("state").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 AND into = 1").select("state"), "plain")
    at = lambda end: plain.select(F.col("state").alias(end), F.lit(True).alias("is"))
    marked = moves
    for end in ("a", "b"):
        marked = marked.join(at(end).hint("merge"), end, "left").withColumn(f"{end}_inner", F.col("is").isNotNull()).drop("is")
    marked = materialise(marked.select("a", "b", "pos", "to", "a_inner", "b_inner"), "marked")
    runs, rings = _pointers(marked)
    single = marked.where("NOT a_inner AND NOT b_inner")
    if rings is not None:
        single = single.union(marked.where("a_inner AND b_inner").join(rings.withColumnRenamed("state", "a").hint("merge"), "a", "left_semi").select(*marked.columns))
    into = marked.where("b_inner AND NOT a_inner").join(runs.withColumnRenamed("state", "b").hint("merge"), "b").selectExpr("run", "a", "pos", "to", "ahead + 2 AS weight")
    out = marked.where("a_inner AND NOT b_inner").selectExpr("a AS run", "b", "to AS name")
    whole = into.join(out.hint("merge"), "run").select("a", "b", "pos", "to", "weight", "run", "name")
    whole = single.selectExpr("a", "b", "pos", "to", "1L AS weight", "CAST(NULL AS BIGINT) AS run", "to AS name").union(whole)
    # numbers rise with a state's order: its moves are in one partition
    arcs = materialise(whole.repartition("a").sortWithinPartitions("a", "pos", "to").withColumn("arc", F.monotonically_increasing_id()), "arcs")
    of = arcs.where("run IS NOT NULL").select("run", "arc", "weight")
    inner = materialise(runs.join(of.hint("merge"), "run").selectExpr("state", "run", "arc", "weight - 1 - ahead AS step"), "inner")
    names = inner.join(marked.where("b_inner").selectExpr("b AS state", "to AS name").hint("merge"), "state").select("arc", "step", "name")
    steps = materialise(arcs.selectExpr("arc", "weight AS step", "name").union(names), "steps")
    return Arcs(arcs.select("arc", "a", "b", "weight", "run"), inner.select("state", "run", "step"), steps)
