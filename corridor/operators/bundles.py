"""Validation of bundles in stages, for all bundles in one plan.

Each rule gives rows ``bundle, stage, rule, row_no, key`` (``row_no`` 0 where it is of no row); some of them stop their bundle, so that
rules of later stages say nothing about what could not be read. The stages: 1 manifest (any
finding stops), 2 configuration (a file that cannot be parsed stops), 3 network (likewise),
4 signals, 5 whether there are nodes to refer to, 6 the header of the demand, 7 its rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files and columns that a bundle must have.
TYPES = ("network", "demand", "config", "signals")
COLUMNS = ("trip_id", "origin_node_id", "destination_node_id", "departure_time_s", "mode")
OUT = ["bundle", "stage", "rule", "row_no", "key"]


class Bundles(NamedTuple):
    """What readers found, by ``bundle``; a file that is absent has no row, one that cannot be parsed has ``parsed`` false and nothing else."""

    bundles: DataFrame  # bundle
    manifests: DataFrame  # parsed, root, has_scenario, scenario_id, has_files
    entries: DataFrame  # type, path, required, sha256
    disk: DataFrame  # path, sha256
    configs: DataFrame  # parsed, root, has_metadata, scenario_id, has_units, length, speed, time
    networks: DataFrame  # parsed, root, has_metadata, length, speed, has_nodes
    nodes: DataFrame  # pos, node
    signals: DataFrame  # parsed, root
    headers: DataFrame  # columns; null without a header
    trips: DataFrame  # row_no, trip_id, origin, destination, departure


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def _when(rows: DataFrame, stage: int, checks: dict[str, Column], key: Column | None = None, row_no: Column | None = None) -> DataFrame:
    """A row for each check that holds."""
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())
    k = key if key is not None else F.lit(None)
    n = row_no if row_no is not None else F.lit(None)
    return rows.select("bundle", F.lit(stage).alias("stage"), F.explode(found).alias("rule"), F.coalesce(n.cast("long"), F.lit(0)).alias("row_no"), k.cast("string").alias("key"))


def _later(rows: DataFrame, name: str, place: str) -> DataFrame:
    """Rows whose filled ``name`` an earlier row of the bundle has."""
    known = rows.where(~_no(F.trim(name)))
    first = known.groupBy("bundle", F.trim(name).alias("_name")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return known.withColumn("_name", F.trim(name)).join(first, ["bundle", "_name"]).where(F.col(place) > F.col("_first"))


def _manifest(b: Bundles) -> list[DataFrame]:
    read = b.bundles.join(b.manifests, "bundle", "left")
    fine = F.coalesce("parsed", F.lit(False))
    good = b.manifests.where("parsed").select("bundle")
    entries = b.entries.join(good, "bundle", "left_semi")
    named = entries.where(~_no(F.col("type")) & ~_no(F.col("path")))
    counts = good.withColumn("type", F.explode(F.array(*map(F.lit, TYPES)))).join(named.groupBy("bundle", "type").agg(F.count("*").alias("n")), ["bundle", "type"], "left")
    there = named.join(b.disk.withColumnRenamed("sha256", "found"), ["bundle", "path"], "left")
    checks = {
        "manifest_missing": F.col("parsed").isNull(), "manifest_unreadable": ~F.col("parsed"), "manifest_root": fine & (F.col("root") != "manifest"), "manifest_scenario": fine & ~F.col("has_scenario"),
        "manifest_files": fine & ~F.col("has_files"), "manifest_scenario_id": fine & F.col("has_scenario") & _no(F.col("scenario_id")),
    }
    return [
        _when(read, 1, checks),
        _when(entries, 1, {"entry_type": _no(F.col("type")), "entry_path": ~_no(F.col("type")) & _no(F.col("path"))}, F.coalesce("path", "type")),
        _when(counts, 1, {"type_missing": F.col("n").isNull(), "type_repeated": F.col("n") > 1}, F.col("type")),
        _when(there, 1, {"file_missing": F.col("required") & F.col("found").isNull(), "hash": ~_no(F.col("sha256")) & (F.col("sha256") != F.col("found"))}, F.col("path")),
    ]


def _documents(b: Bundles) -> list[DataFrame]:
    """Stages 2 to 5. Absent files were found out in the first."""
    ids = b.manifests.where("parsed").select("bundle", F.col("scenario_id").alias("own_id"))
    fine, filled = F.coalesce("parsed", F.lit(False)), lambda *names: reduce(lambda a, c: a & c, (~_no(F.col(n)) for n in names))
    config = {
        "config_unreadable": ~F.col("parsed"), "config_root": fine & (F.col("root") != "config"), "config_metadata": fine & ~F.col("has_metadata"), "config_scenario_id": fine & F.col("has_metadata") & _no(F.col("scenario_id")),
        "scenario_ids_differ": fine & F.col("has_metadata") & filled("own_id", "scenario_id") & (F.col("own_id") != F.col("scenario_id")), "config_units": fine & ~F.col("has_units"), "config_unit": fine & F.col("has_units") & ~filled("length", "speed", "time"),
    }
    units = b.configs.where("parsed AND has_units").select("bundle", F.col("length").alias("own_length"), F.col("speed").alias("own_speed"))
    both = lambda x: fine & F.col("has_metadata") & filled(x, f"own_{x}") & (F.col(x) != F.col(f"own_{x}"))
    network = {
        "network_unreadable": ~F.col("parsed"), "network_root": fine & (F.col("root") != "network"), "network_metadata": fine & ~F.col("has_metadata"), "network_unit": fine & F.col("has_metadata") & ~filled("length", "speed"),
        "network_nodes": fine & ~F.col("has_nodes"), "length_units_differ": both("length"), "speed_units_differ": both("speed"),
    }
    open_nodes = b.nodes.join(b.networks.where("parsed AND has_nodes").select("bundle"), "bundle", "left_semi")
    known = open_nodes.where(~_no(F.col("node"))).select("bundle").distinct().withColumn("_some", F.lit(True))
    return [
        _when(b.configs.join(ids, "bundle", "left"), 2, config),
        _when(b.networks.join(units, "bundle", "left"), 3, network),
        _when(open_nodes, 3, {"node_id": _no(F.col("node"))}, row_no=F.col("pos")),
        _when(_later(open_nodes, "node", "pos"), 3, {"node_repeated": F.lit(True)}, F.col("node"), F.col("pos")),
        _when(b.signals, 4, {"signals_unreadable": ~F.col("parsed"), "signals_root": fine & (F.col("root") != "signals")}),
        _when(b.bundles.join(known, "bundle", "left"), 5, {"no_nodes": F.col("_some").isNull()}),
    ]


def _demand(b: Bundles) -> list[DataFrame]:
    lacking = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, COLUMNS)), "columns")), ", ")
    header = {"header": F.col("columns").isNull(), "columns": F.size(F.array_except(F.array(*map(F.lit, COLUMNS)), "columns")) > 0}
    trips = b.trips.select("bundle", "row_no", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("trip_id", "origin", "destination", "departure")))
    nodes = b.nodes.where(~_no(F.col("node"))).select("bundle", "node").distinct()
    at = lambda end: nodes.select("bundle", F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    rows = trips.join(at("origin"), ["bundle", "origin"], "left").join(at("destination"), ["bundle", "destination"], "left")
    number = F.when(F.col("departure").rlike(r"^[+-]?\d+$"), F.col("departure").try_cast("long"))
    checks = {
        "trip_id": F.col("trip_id") == "", "self_loop": (F.col("origin") != "") & (F.col("origin") == F.col("destination")), "origin": F.col("_origin").isNull(), "destination": F.col("_destination").isNull(),
        "departure": number.isNull(), "departure_negative": number < 0,
    }
    some = trips.select("bundle").distinct().withColumn("_some", F.lit(True))
    return [
        _when(b.headers, 6, header, lacking),
        _when(rows, 7, checks, row_no=F.col("row_no")),
        _when(_later(trips, "trip_id", "row_no"), 7, {"trip_repeated": F.lit(True)}, row_no=F.col("row_no")),
        _when(b.bundles.join(some, "bundle", "left"), 7, {"no_trips": F.col("_some").isNull()}),
    ]


#: Findings that stop their bundle besides all of the first stage.
STOPS = ("config_unreadable", "network_unreadable", "no_nodes", "header", "columns")


def violations(b: Bundles) -> DataFrame:
    """All findings that count: those up to the stage at which a bundle stops."""
    found = reduce(DataFrame.union, [*_manifest(b), *_documents(b), *_demand(b)]).select(*OUT)
    stops = found.where((F.col("stage") == 1) | F.col("rule").isin(*STOPS)).groupBy("bundle").agg(F.min("stage").alias("_stop"))
    return found.join(stops, "bundle", "left").where("_stop IS NULL OR stage <= _stop").select(*OUT)


def verdicts(b: Bundles, found: DataFrame) -> DataFrame:
    """``bundle, valid, findings`` of every bundle."""
    n = found.groupBy("bundle").agg(F.count("*").alias("n"))
    return b.bundles.join(n, "bundle", "left").select("bundle", F.col("n").isNull().alias("valid"), F.coalesce("n", F.lit(0)).alias("findings"))
