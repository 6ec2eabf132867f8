"""Queries on demand, networks and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import views
from corridor.functions import numbers
from corridor.operators import demand, events, network
from corridor.registry import query

_HOUR_US = 3_600_000_000
_SCC = (
    ", reach AS (SELECT from_node AS s, to_node AS t FROM links UNION SELECT r.s, l.to_node FROM reach r JOIN links l ON r.t = l.from_node), "
    "nodes AS (SELECT from_node AS node FROM links UNION SELECT to_node FROM links), "
    "comp AS (SELECT n.node, coalesce(least(n.node, min(a.t)), n.node) AS root FROM nodes n LEFT JOIN reach a ON a.s = n.node AND EXISTS (SELECT 1 FROM reach b WHERE b.s = a.t AND b.t = n.node) GROUP BY n.node), "
    "big AS (SELECT root FROM comp GROUP BY root ORDER BY count(*) DESC, root LIMIT 1), scc AS (SELECT node FROM comp WHERE root = (SELECT root FROM big)) "
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(" , reach AS", ", reach AS")


_COMPONENTS: dict[tuple[str, str], object] = {}


def component(spark, sf_dir):
    """The largest component of a folder's links; searched once a session, as many queries want it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COMPONENTS:
        _COMPONENTS[key] = network.largest_component(views.links(spark, sf_dir))
    return _COMPONENTS[key]


def _nodes(links):
    return links.select(F.col("from_node").alias("node")).union(links.select(F.col("to_node").alias("node"))).distinct()


@query(
    "agg_demand_composition",
    views.with_views(
        "trips",
        "SELECT count(*) AS total, count(*) FILTER (purpose LIKE '%\\_AM%' ESCAPE '\\') AS am, count(*) FILTER (purpose LIKE '%\\_PM%' ESCAPE '\\') AS pm, "
        "count(*) FILTER (purpose LIKE '%chained' OR purpose LIKE 'HBSchool%') AS chain_legs, count(*) FILTER (purpose = 'HBSchool_AM') AS school_chains_am, "
        "count(*) FILTER (purpose = 'HBSchool_PM') AS school_chains_pm FROM trips WHERE trim(coalesce(purpose, '')) <> ''",
    ),
)
def agg_demand_composition(spark, sf_dir):
    return demand.composition(views.trips(spark, sf_dir))


@query("src_demand_composition", views.with_views("trips", "SELECT coalesce(purpose, 'all') AS purpose, count(*) AS trips FROM trips WHERE trim(coalesce(purpose, '')) <> '' GROUP BY ROLLUP (purpose)"))
def src_demand_composition(spark, sf_dir):
    return demand.by_purpose(views.trips(spark, sf_dir)).withColumn("purpose", F.coalesce("purpose", F.lit("all")))


@query("agg_od_matrix", views.with_views("od", "SELECT o, d, count(*) AS volume FROM od WHERE o <> d GROUP BY o, d"))
def agg_od_matrix(spark, sf_dir):
    return demand.od_matrix(views.od(spark, sf_dir))


@query("agg_od_totals", views.with_views("od", "SELECT count(*) AS pairs, CAST(coalesce(sum(volume), 0) AS BIGINT) AS vehicles FROM (SELECT o, d, count(*) AS volume FROM od WHERE o <> d GROUP BY o, d)"))
def agg_od_totals(spark, sf_dir):
    return demand.od_matrix(views.od(spark, sf_dir)).agg(F.count("*").alias("pairs"), F.coalesce(F.sum("volume"), F.lit(0)).alias("vehicles"))


@query("agg_demand_nodes", views.with_views("trips", "SELECT origin AS node FROM trips WHERE trim(coalesce(origin, '')) <> '' UNION SELECT destination FROM trips WHERE trim(coalesce(destination, '')) <> ''"))
def agg_demand_nodes(spark, sf_dir):
    return demand.node_ids(views.trips(spark, sf_dir))


@query("agg_unique_od", views.with_views("trips", "SELECT count(DISTINCT origin) AS origins, count(DISTINCT destination) AS destinations FROM trips"))
def agg_unique_od(spark, sf_dir):
    return views.trips(spark, sf_dir).agg(F.count_distinct("origin").alias("origins"), F.count_distinct("destination").alias("destinations"))


@query("agg_origin_counts", views.with_views("trips", "SELECT origin, count(*) AS trips FROM trips GROUP BY origin"))
def agg_origin_counts(spark, sf_dir):
    return views.trips(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("trips"))


@query(
    "agg_demand_stats",
    views.with_views(
        "trips",
        "SELECT coalesce(mode, 'all') AS mode, coalesce(source, 'all') AS source, count(*) AS trips, min(departure_time_s) AS first_s, max(departure_time_s) AS last_s "
        "FROM (SELECT *, CASE WHEN purpose LIKE '%chained' THEN 'schedule' ELSE 'gravity' END AS source FROM trips) GROUP BY GROUPING SETS ((mode), (source), ())",
    ),
)
def agg_demand_stats(spark, sf_dir):
    rows = views.trips(spark, sf_dir).withColumn("source", F.when(F.col("purpose").endswith("chained"), "schedule").otherwise("gravity"))
    sets = rows.groupingSets([["mode"], ["source"], []], "mode", "source").agg(F.count("*").alias("trips"), F.min("departure_time_s").alias("first_s"), F.max("departure_time_s").alias("last_s"))
    return sets.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("mode", "source")})


@query(
    "win_dense_trip_id",
    views.with_views("trips", "SELECT trip_id, 't' || (row_number() OVER (ORDER BY departure_time_s, origin, destination NULLS FIRST, trip_id) - 1) AS dense_id FROM trips"),
)
def win_dense_trip_id(spark, sf_dir):
    return demand.dense_ids(views.trips(spark, sf_dir)).select("trip_id", "dense_id")


#: Demand with every kind of fault, in Spark's SQL and DuckDB's alike.
_FAULTY = [
    "pos",
    "CASE pos % 41 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'twice' ELSE trip_id END AS trip_id",
    "origin",
    "CASE WHEN pos % 29 = 0 THEN origin WHEN pos % 31 = 0 THEN 'nowhere' ELSE destination END AS destination",
    "CASE pos % 23 WHEN 0 THEN '-5' WHEN 1 THEN 'noon' WHEN 2 THEN NULL WHEN 3 THEN '12.5' ELSE CAST(departure_time_s AS STRING) END AS departure",
]
_NODES = "nodes AS (SELECT from_node AS node FROM links UNION SELECT to_node FROM links)"
_FAULTS = {
    "val_trip_dup": "SELECT pos, 'empty_id' AS rule FROM t WHERE trim(coalesce(trip_id, '')) = '' UNION ALL SELECT pos, 'duplicate_id' FROM "
    "(SELECT pos, row_number() OVER (PARTITION BY trip_id ORDER BY pos) AS k FROM t WHERE trim(coalesce(trip_id, '')) <> '') WHERE k > 1",
    "val_trip_selfloop": "SELECT pos, 'self_loop' AS rule FROM t WHERE origin = destination",
    "val_trip_departure": "SELECT pos, CASE WHEN TRY_CAST(departure AS BIGINT) IS NULL OR departure LIKE '%.%' THEN 'departure_not_integer' ELSE 'departure_negative' END AS rule FROM t "
    "WHERE TRY_CAST(departure AS BIGINT) IS NULL OR departure LIKE '%.%' OR TRY_CAST(departure AS BIGINT) < 0",
    "join_fk_demand": "SELECT pos, 'orphan_origin' AS rule FROM t WHERE origin IS NOT NULL AND origin NOT IN (SELECT node FROM nodes) "
    "UNION ALL SELECT pos, 'orphan_destination' FROM t WHERE destination IS NOT NULL AND destination NOT IN (SELECT node FROM nodes)",
    "val_trip_empty": "SELECT CAST(0 AS BIGINT) AS pos, 'empty' AS rule WHERE NOT EXISTS (SELECT 1 FROM t WHERE pos < 0)",
}


def _faulty(spark, sf_dir):
    rows = views.trips(spark, sf_dir).withColumn("pos", F.substring("trip_id", 2, 20).cast("long"))
    return rows.selectExpr(*_FAULTY)


def _faulty_sql(select):
    trips = "t AS (SELECT " + ", ".join(_FAULTY) + " FROM (SELECT *, CAST(substr(trip_id, 2) AS BIGINT) AS pos FROM trips))"
    return views.with_views("trips links", f", {_NODES}, {trips} {select}").replace(" , nodes AS", ", nodes AS")


@query("val_trip_dup", _faulty_sql(_FAULTS["val_trip_dup"]))
def val_trip_dup(spark, sf_dir):
    return demand.repeated_ids(_faulty(spark, sf_dir))


@query("val_trip_selfloop", _faulty_sql(_FAULTS["val_trip_selfloop"]))
def val_trip_selfloop(spark, sf_dir):
    return demand.self_loops(_faulty(spark, sf_dir))


@query("val_trip_departure", _faulty_sql(_FAULTS["val_trip_departure"]))
def val_trip_departure(spark, sf_dir):
    return demand.bad_departures(_faulty(spark, sf_dir))


@query("join_fk_demand", _faulty_sql(_FAULTS["join_fk_demand"]))
def join_fk_demand(spark, sf_dir):
    return demand.orphans(_faulty(spark, sf_dir), _nodes(views.links(spark, sf_dir)))


@query("val_trip_empty", _faulty_sql(_FAULTS["val_trip_empty"]))
def val_trip_empty(spark, sf_dir):
    return demand.empty_table(_faulty(spark, sf_dir).where("pos < 0"))


@query("val_demand", _faulty_sql("SELECT rule, count(*) AS violations FROM (" + " UNION ALL ".join(f"({v})" for k, v in _FAULTS.items() if k != "val_trip_empty") + ") GROUP BY rule"))
def val_demand(spark, sf_dir):
    return demand.violations(_faulty(spark, sf_dir), _nodes(views.links(spark, sf_dir))).groupBy("rule").agg(F.count("*").alias("violations"))


@query("agg_degree", views.with_views("links", "SELECT node, count(*) AS degree FROM (SELECT from_node AS node FROM links UNION ALL SELECT to_node FROM links) GROUP BY node"))
def agg_degree(spark, sf_dir):
    return network.degree(views.links(spark, sf_dir))


_INDEX = (
    ", ends AS (SELECT from_node AS node, 'out' AS e, link_pos, link_id, to_node IN (SELECT from_node FROM links) AS onward FROM links UNION ALL SELECT to_node, 'in', link_pos, link_id, false FROM links), "
    "ix AS (SELECT node, bool_or(e = 'out') AS goes_on, arg_min(link_id, link_pos) FILTER (e = 'in') AS into_, arg_min(link_id, link_pos) FILTER (e = 'out' AND onward) AS onward, "
    "arg_min(link_id, link_pos) AS touching, arg_min(link_id, link_pos) FILTER (e = 'out') AS out_ FROM ends GROUP BY node) "
)


@query("join_first_link", views.with_views("links", _INDEX + "SELECT node, goes_on, into_ AS \"into\", onward, touching, out_ AS \"out\" FROM ix").replace(" , ends AS", ", ends AS"))
def join_first_link(spark, sf_dir):
    return network.link_index(views.links(spark, sf_dir))


def _trip_links(spark, sf_dir, side, choose):
    links = views.links(spark, sf_dir)
    ends = views.trips(spark, sf_dir).where(F.col(side).isNotNull()).select("trip_id", F.col(side).alias("node"))
    return ends.join(network.link_index(links), "node", "left").crossJoin(F.broadcast(network.first_of_all(links))).select("trip_id", F.coalesce(*choose, "fallback").alias("link_id"))


@query("join_origin_link", views.with_views("links trips", _INDEX + "SELECT trip_id, coalesce(CASE WHEN goes_on THEN into_ END, onward, touching, (SELECT arg_min(link_id, link_pos) FROM links)) AS link_id FROM trips LEFT JOIN ix ON origin = node WHERE origin IS NOT NULL").replace(" , ends AS", ", ends AS"))
def join_origin_link(spark, sf_dir):
    return _trip_links(spark, sf_dir, "origin", (F.when(F.col("goes_on"), F.col("into")), "onward", "touching"))


@query("join_dest_link", views.with_views("links trips", _INDEX + "SELECT trip_id, coalesce(out_, into_, (SELECT arg_min(link_id, link_pos) FROM links)) AS link_id FROM trips LEFT JOIN ix ON destination = node WHERE destination IS NOT NULL").replace(" , ends AS", ", ends AS"))
def join_dest_link(spark, sf_dir):
    return _trip_links(spark, sf_dir, "destination", ("out", "into"))


#: Lengths that fall into every class.
_LENGTH = "CASE link_pos % 7 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN 0.05 WHEN 3 THEN 0.5 WHEN 4 THEN -1.0 WHEN 5 THEN 5.0 ELSE length END"


@query(
    "agg_length_hist",
    views.with_views(
        "links",
        f", h AS (SELECT CASE WHEN coalesce(x, 0) = 0 THEN '0' WHEN x < 0.1 THEN '<0.1' WHEN x < 1 THEN '<1' WHEN x < 10 THEN '<10' WHEN x < 100 THEN '<100' ELSE '>=100' END AS bucket, count(*) AS links FROM (SELECT {_LENGTH} AS x FROM links) GROUP BY 1) "
        "SELECT bucket, links, round(links * 100 / (SELECT sum(links) FROM h), 6) AS percent FROM h",
    ).replace(" , h AS", ", h AS"),
)
def agg_length_hist(spark, sf_dir):
    found = network.length_histogram(views.links(spark, sf_dir).withColumn("length", F.expr(_LENGTH).cast("double")))
    return found.withColumn("percent", numbers.rounded("percent", 6))


_RULES = "r AS (SELECT CASE WHEN link_pos % 2 = 0 THEN 'no_left_turn' ELSE 'only_straight_on' END AS type, link_id AS from_link, to_node AS via_node, (SELECT min(o.link_id) FROM links o WHERE o.from_node = l.to_node) AS to_link FROM links l)"


@query(
    "join_only_restrictions",
    views.with_views(
        "links",
        f", {_RULES} SELECT via_node, from_link, to_link FROM r WHERE type LIKE 'no_%' AND to_link IS NOT NULL "
        "UNION SELECT r.via_node, r.from_link, o.link_id FROM r JOIN links o ON o.from_node = r.via_node WHERE type LIKE 'only_%' AND to_link IS NOT NULL AND o.link_id <> r.to_link",
    ).replace(" , r AS", ", r AS"),
)
def join_only_restrictions(spark, sf_dir):
    links = views.links(spark, sf_dir)
    least = links.groupBy(F.col("from_node").alias("via_node")).agg(F.min("link_id").alias("to_link"))
    kind = F.when(F.col("link_pos") % 2 == 0, "no_left_turn").otherwise("only_straight_on")
    rules = links.select(kind.alias("type"), F.col("link_id").alias("from_link"), F.col("to_node").alias("via_node")).join(least, "via_node")
    return network.forbidden_moves(rules, links)


@query("gr_scc", _recursive(views.with_views("links", _SCC + "SELECT node FROM scc")))
def gr_scc(spark, sf_dir):
    return component(spark, sf_dir)


@query(
    "gr_bfs",
    _recursive(
        views.with_views(
            "links",
            ", s AS (SELECT min(from_node) AS node FROM links), reach AS (SELECT node, CAST(0 AS BIGINT) AS hops FROM s UNION SELECT l.to_node, r.hops + 1 FROM reach r JOIN links l ON l.from_node = r.node WHERE r.hops < 60) "
            "SELECT node, min(hops) AS hops FROM reach GROUP BY node",
        ).replace(" , s AS", ", s AS")
    ),
)
def gr_bfs(spark, sf_dir):
    links = views.links(spark, sf_dir)
    return network.hops(links, links.agg(F.min("from_node").alias("node")))


@query("gr_bfs_paths")  # no SQL: it has no first-come order of search; tests/test_operators.py holds the paths against a search in Python
def gr_bfs_paths(spark, sf_dir):
    found = network.paths(views.links(spark, sf_dir), views.trips(spark, sf_dir).select("trip_id", "origin", "destination"))
    return found.select("trip_id", "origin", "destination", F.array_join("path", " ").alias("path"))


@query(
    "flt_feasible",
    _recursive(
        views.with_views(
            "links trips",
            _SCC + "SELECT reason, count(*) AS trips, count(DISTINCT trip_id) AS ids FROM (SELECT trip_id, CASE WHEN trim(coalesce(origin, '')) = '' OR trim(coalesce(destination, '')) = '' THEN 'missing_fields' "
            "WHEN origin NOT IN (SELECT node FROM nodes) OR destination NOT IN (SELECT node FROM nodes) THEN 'unknown_node' "
            "WHEN origin NOT IN (SELECT node FROM scc) OR destination NOT IN (SELECT node FROM scc) THEN 'outside_scc' "
            "WHEN trim(coalesce(mode, '')) <> '' AND mode <> 'car' THEN 'unsupported_mode' ELSE 'feasible' END AS reason FROM trips) GROUP BY reason",
        )
    ),
)
def flt_feasible(spark, sf_dir):
    links = views.links(spark, sf_dir)
    found = demand.classify(views.trips(spark, sf_dir), _nodes(links), component(spark, sf_dir), ("car",))
    return found.groupBy("reason").agg(F.count("*").alias("trips"), F.count_distinct("trip_id").alias("ids"))


@query("agg_throughput", views.with_views("link_events", f"SELECT t // {_HOUR_US} * {_HOUR_US} AS bin, link, count(*) AS n FROM link_events WHERE type = 'entered' GROUP BY 1, 2"))
def agg_throughput(spark, sf_dir):
    return events.throughput(views.link_events(spark, sf_dir), _HOUR_US)


_VISITS = (
    "v AS (SELECT veh, link, t_in, t AS t_out FROM (SELECT *, lag(type) OVER w AS type_before, lag(t) OVER w AS t_in FROM link_events WINDOW w AS (PARTITION BY veh, link ORDER BY t, pos)) "
    "WHERE type = 'left' AND type_before = 'entered' AND t > t_in)"
)


@query("join_event_pair", views.with_views("link_events", f", {_VISITS} SELECT * FROM v").replace(" , v AS", ", v AS"))
def join_event_pair(spark, sf_dir):
    return events.visits(views.link_events(spark, sf_dir))


@query(
    "join_active_at_t",
    views.with_views(
        "link_events",
        f", {_VISITS}, f AS (SELECT DISTINCT t // {24 * _HOUR_US} * {24 * _HOUR_US} AS t FROM link_events) SELECT f.t, count(*) AS active FROM f JOIN v ON f.t BETWEEN t_in AND t_out GROUP BY f.t",
    ).replace(" , v AS", ", v AS"),
)
def join_active_at_t(spark, sf_dir):
    rows = views.link_events(spark, sf_dir)
    frames = rows.select((F.floor(F.col("t") / (24 * _HOUR_US)).cast("long") * 24 * _HOUR_US).alias("t")).distinct()
    return events.active_at(events.visits(rows), frames, 24 * _HOUR_US)
