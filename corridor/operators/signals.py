"""Traffic signals: which nodes have one, and their phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of yellow, of all red and of the least green, and of a cycle.
YELLOW, ALL_RED, LEAST_GREEN, CYCLE = 3, 2, 5, 90


def signal_nodes(nodes: DataFrame, least_degree: int = 4, most: int | None = None) -> DataFrame:
    """Nodes (``node, degree, has_signal``) with a signal: the tagged ones if any is, else those of ``least_degree``.

    Tagged nodes go by id, others by falling degree and id; ``most`` keeps the first of them.
    """
    any_tag = nodes.agg(F.coalesce(F.bool_or("has_signal"), F.lit(False)).alias("any_tag"))  # one row
    rows = nodes.crossJoin(F.broadcast(any_tag))
    found = rows.where(F.when(F.col("any_tag"), F.col("has_signal")).otherwise(F.col("degree") >= least_degree))
    if most is None:
        return found.select("node")
    return found.orderBy(F.when(F.col("any_tag"), 0).otherwise(-F.col("degree")), "node").limit(most).select("node")


def alternating(links: DataFrame) -> DataFrame:
    """``node, group_1, group_2``: a node's incoming links in turn, by position."""
    turn = F.row_number().over(W.partitionBy("to_node").orderBy("link_pos")) % 2
    rows = links.select(F.col("to_node").alias("node"), "link_pos", "link_id", turn.alias("turn"))
    group = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("turn") == k, F.struct("link_pos", "link_id")))), lambda x: x["link_id"])
    return rows.groupBy("node").agg(group(1).alias("group_1"), group(0).alias("group_2"))


def phases(first: Column, second: Column, cycle: int = CYCLE) -> Column:
    """The six phases of a two-group plan: green, yellow and all red for each."""
    rest = cycle - 2 * (YELLOW + ALL_RED)
    if rest < 2 * LEAST_GREEN:
        raise ValueError(f"a cycle of {cycle} s has no room for two greens of {LEAST_GREEN} s")
    none = F.array().cast("array<string>")
    plan = [
        ("p1", rest // 2, "G", first), ("p1y", YELLOW, "y", first), ("ar1", ALL_RED, "r", none),
        ("p2", rest - rest // 2, "G", second), ("p2y", YELLOW, "y", second), ("ar2", ALL_RED, "r", none),
    ]
    return F.array(*(F.struct(F.lit(n).alias("phase"), F.lit(s).alias("seconds"), F.lit(c).alias("state"), x.alias("links")) for n, s, c, x in plan))


def controllers(nodes: DataFrame, links: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """``node, cycle_s, phases`` of each signal node."""
    groups = nodes.join(alternating(links), "node", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return groups.select("node", F.lit(cycle).alias("cycle_s"), phases(empty(F.col("group_1")), empty(F.col("group_2")), cycle).alias("phases"))
