"""Demand tables: composition, origin-destination matrices, feasibility, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.operators.ranges import numbered

#: Purposes of the morning, the afternoon and of chains.
AM = ("HBW_AM", "HBSchool_AM", "HBW_AM_chained")
PM = ("HBW_PM", "HBSchool_PM", "HBW_PM_chained")
CHAINED = ("HBSchool_AM", "HBW_AM_chained", "HBW_PM_chained", "HBSchool_PM")
#: Modes a trip may name.
KNOWN_MODES = ("car", "transit", "bike", "walk")


def missing(c: str) -> Column:
    """Null, empty or blank."""
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def composition(trips: DataFrame) -> DataFrame:
    """Trips with a purpose: all, of the morning, of the afternoon, legs of chains, and chains by their school leg."""
    n = lambda *names: F.count(F.when(F.col("purpose").isin(*names), 1))
    return trips.where(~missing("purpose")).agg(
        F.count("*").alias("total"), n(*AM).alias("am"), n(*PM).alias("pm"), n(*CHAINED).alias("chain_legs"),
        n("HBSchool_AM").alias("school_chains_am"), n("HBSchool_PM").alias("school_chains_pm"),
    )


def by_purpose(trips: DataFrame) -> DataFrame:
    """Trips by purpose, with a row of all (null purpose)."""
    return trips.where(~missing("purpose")).rollup("purpose").agg(F.count("*").alias("trips"))


def od_matrix(pairs: DataFrame) -> DataFrame:
    """Trips by origin and other destination."""
    return pairs.where("o <> d").groupBy("o", "d").agg(F.count("*").alias("volume"))


def node_ids(trips: DataFrame) -> DataFrame:
    """Nodes that any trip begins or ends at."""
    return trips.select(F.col("origin").alias("node")).union(trips.select(F.col("destination").alias("node"))).where(~missing("node")).distinct()


def classify(trips: DataFrame, nodes: DataFrame, component: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """``trips`` with ``reason``: the first of missing fields, unknown node, outside the component, unsupported mode, else ok."""
    known = nodes.select(F.col("node").alias("k"), F.lit(True).alias("known"))
    inside = component.select(F.col("node").alias("k"), F.lit(True).alias("inside"))
    rows = trips
    for side in ("origin", "destination"):
        for frame, flag in ((known, "known"), (inside, "inside")):
            rows = rows.join(frame.withColumnsRenamed({"k": side, flag: f"{side}_{flag}"}), side, "left")
    lacks = lambda flag: F.col(f"origin_{flag}").isNull() | F.col(f"destination_{flag}").isNull()
    reason = (
        F.when(missing("trip_id") | missing("origin") | missing("destination"), "missing_fields")
        .when(lacks("known"), "unknown_node")
        .when(lacks("inside"), "outside_scc")
        .when(~missing("mode") & ~F.col("mode").isin(*modes), "unsupported_mode")
        .otherwise("feasible")
    )
    return rows.select(*trips.columns, reason.alias("reason"))


def dense_ids(trips: DataFrame) -> DataFrame:
    """``trips`` with ``dense_id``: t0, t1, ... by departure, origin, destination and id. Ranges are seconds of departure."""
    order = ["departure_time_s", "origin", "destination", "trip_id"]
    ranked = numbered(trips, order, F.col("departure_time_s"), "_id")
    return ranked.select(*trips.columns, F.concat(F.lit("t"), F.col("_id")).alias("dense_id"))


def repeated_ids(trips: DataFrame) -> DataFrame:
    """Trips without an id, and each repeat of an id after its first row (by ``pos``)."""
    blank = trips.where(missing("trip_id")).select("pos", F.lit("empty_id").alias("rule"))
    # counts first: only ids that repeat are ordered
    often = trips.where(~missing("trip_id")).groupBy("trip_id").agg(F.count("*").alias("k"), F.min("pos").alias("first")).where("k > 1")
    again = trips.join(often, "trip_id").where("pos > first").select("pos", F.lit("duplicate_id").alias("rule"))
    return blank.union(again)


def self_loops(trips: DataFrame) -> DataFrame:
    return trips.where("origin = destination").select("pos", F.lit("self_loop").alias("rule"))


def bad_departures(trips: DataFrame) -> DataFrame:
    """Departures (text) that are no whole number, or a negative one."""
    text = F.trim(F.coalesce(F.col("departure"), F.lit("")))
    whole = text.rlike(r"^[+-]?\d+$")
    rule = F.when(~whole, "departure_not_integer").when(text.startswith("-") & ~text.rlike(r"^-0+$"), "departure_negative")
    return trips.select("pos", rule.alias("rule")).where("rule IS NOT NULL")


def orphans(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of trips that no node has."""
    found = [
        trips.where(~missing(side)).join(nodes.select(F.col("node").alias(side)), side, "left_anti").select("pos", F.lit(f"orphan_{side}").alias("rule"))
        for side in ("origin", "destination")
    ]
    return found[0].union(found[1])


def empty_table(trips: DataFrame) -> DataFrame:
    """One row where there is no trip at all."""
    return trips.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("pos"), F.lit("empty").alias("rule"))


def violations(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pos, rule`` of every violation."""
    rows = repeated_ids(trips).union(self_loops(trips)).union(bad_departures(trips))
    return rows.union(orphans(trips, nodes)).union(empty_table(trips))
