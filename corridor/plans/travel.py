"""Queries on routing, generated demand, trips by place, and frames of maps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corridor import views
from corridor.functions import numbers, roads
from corridor.operators import demand, draws, generate, network, ranges
from corridor.operators.statistics import rounded
from corridor.plans.networks import _SCC, _recursive, component
from corridor.registry import query
from corridor.session import shared_dir
from corridor.sources import runspec

_MOVES = "CASE WHEN link_pos % 2 = 0 THEN 'no_left_turn' ELSE 'only_straight_on' END"


def _forbidden(spark, sf_dir):
    """Moves that restrictions on every fifth link forbid."""
    links = views.links(spark, sf_dir)
    least = links.groupBy(F.col("from_node").alias("via_node")).agg(F.min("link_id").alias("to_link"))
    rules = links.where("link_pos % 5 = 0").selectExpr(f"{_MOVES} AS type", "link_id AS from_link", "to_node AS via_node").join(least, "via_node")
    return network.forbidden_moves(rules, links)


def _some_trips(spark, sf_dir):
    return views.trips(spark, sf_dir).select("trip_id", "origin", "destination")


def _texts(found):
    return found.select("trip_id", "origin", "destination", F.array_join("path", " ").alias("path"))


@query("gr_bfs_restricted")  # no SQL: tests/test_operators.py holds it against a search in Python
def gr_bfs_restricted(spark, sf_dir):
    return _texts(network.restricted_paths(views.links(spark, sf_dir), _some_trips(spark, sf_dir), _forbidden(spark, sf_dir)))


@query("gr_routes")  # no SQL, as above
def gr_routes(spark, sf_dir):
    return _texts(network.routes(views.links(spark, sf_dir), _some_trips(spark, sf_dir), _forbidden(spark, sf_dir)))


@query("gr_routes_scenario")  # no SQL, as above
def gr_routes_scenario(spark, sf_dir):
    links = views.links(spark, sf_dir)
    nodes = links.select(F.col("from_node").alias("node")).union(links.select(F.col("to_node").alias("node"))).distinct()
    feasible = demand.classify(views.trips(spark, sf_dir), nodes, component(spark, sf_dir), ("car",)).where("reason = 'feasible'")
    return _texts(network.routes(links, feasible.select("trip_id", "origin", "destination"), _forbidden(spark, sf_dir)))


_REACH = (
    ", tp AS (SELECT DISTINCT origin AS s FROM trips WHERE origin IS NOT NULL), walk AS (SELECT s, s AS node, CAST(0 AS BIGINT) AS hops FROM tp UNION SELECT w.s, l.to_node, w.hops + 1 FROM walk w JOIN links l ON l.from_node = w.node WHERE w.hops < 25), "
    "far AS (SELECT s, node, min(hops) AS hops FROM walk GROUP BY ALL) "
)


for _name in ("gr_bfs_sumo", "topk_unroutable"):
    _top = _name == "topk_unroutable"

    def _hops(spark, sf_dir, top=_top):
        found = network.hop_counts(views.links(spark, sf_dir), _some_trips(spark, sf_dir))
        if not top:
            return found.where("hops IS NOT NULL").select("trip_id", "hops")
        lost = found.where("hops IS NULL OR hops > 5")
        return lost.orderBy("trip_id").limit(5).select("trip_id").crossJoin(lost.agg(F.count("*").alias("n")))  # one row

    query(
        _name,
        _recursive(
            views.with_views(
                "links trips",
                _REACH + ("SELECT trip_id, hops FROM trips JOIN far ON s = origin AND node = destination" if not _top else ", lost AS (SELECT trip_id FROM trips LEFT JOIN far ON s = origin AND node = destination WHERE hops IS NULL OR hops > 5) SELECT trip_id, (SELECT count(*) FROM lost) AS n FROM lost ORDER BY trip_id LIMIT 5"),
            ).replace(" , tp AS", ", tp AS").replace(" , lost AS", ", lost AS")
        ),
    )(_hops)


#: The largest component and what hangs on it.
def _scc_query(name, sql, build):
    query(name, _recursive(views.with_views("links trips", _SCC + sql)))(lambda spark, sf_dir: build(views.links(spark, sf_dir), component(spark, sf_dir)))


def _within(links, nodes):
    return links.join(nodes.select(F.col("node").alias("from_node")), "from_node", "left_semi").join(nodes.select(F.col("node").alias("to_node")), "to_node", "left_semi")


_IN = "from_node IN (SELECT node FROM scc) AND to_node IN (SELECT node FROM scc)"
_scc_query("flt_scc_nodes", f"SELECT link_id, from_node, to_node FROM links WHERE {_IN}", lambda links, scc: _within(links, scc).select("link_id", "from_node", "to_node"))
_scc_query("flt_scc_matsim", f"SELECT link_id FROM links WHERE {_IN} AND from_node <> to_node", lambda links, scc: _within(links, scc).where("from_node <> to_node").select("link_id"))
_scc_query("agg_scc_links", f"SELECT (SELECT count(*) FROM scc) AS nodes, (SELECT count(*) FROM links WHERE {_IN}) AS links", lambda links, scc: scc.agg(F.count("*").alias("nodes")).crossJoin(_within(links, scc).agg(F.count("*").alias("links"))))
_scc_query("gr_scc_synth", "SELECT node FROM scc", lambda links, scc: scc)
# inside a strong component every node reaches all others: the pairs are never made
_scc_query("gr_reachability", "SELECT node, (SELECT count(*) FROM scc) - 1 AS reachable FROM scc", lambda links, scc: scc.crossJoin(F.broadcast(scc.agg((F.count("*") - 1).alias("reachable")))))
_scc_query(
    "agg_origin_weight", "SELECT node, CAST(sum(CAST(substr(node, 2) AS BIGINT) % 7) AS BIGINT) AS weight FROM scc WHERE CAST(substr(node, 2) AS BIGINT) % 7 > 0 GROUP BY node",
    lambda links, scc: scc.withColumn("p", F.substring("node", 2, 9).cast("long") % 7).where("p > 0").groupBy("node").agg(F.sum("p").alias("weight")),
)


@query(
    "join_trip_nodes",
    views.with_views(
        "links trips",
        ", nodes AS (SELECT from_node AS node FROM links UNION SELECT to_node FROM links) SELECT trip_id, origin IN (SELECT node FROM nodes) AS origin_known, coalesce(destination IN (SELECT node FROM nodes), false) AS destination_known FROM trips",
    ).replace(" , nodes AS", ", nodes AS"),
)
def join_trip_nodes(spark, sf_dir):
    links = views.links(spark, sf_dir)
    nodes = links.select(F.col("from_node").alias("node")).union(links.select(F.col("to_node").alias("node"))).distinct()
    rows = views.trips(spark, sf_dir).select("trip_id", "origin", "destination")
    for side in ("origin", "destination"):
        rows = rows.join(nodes.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_known")), side, "left")
    return rows.select("trip_id", *(F.coalesce(f"{s}_known", F.lit(False)).alias(f"{s}_known") for s in ("origin", "destination")))


@query("agg_dest_counts", views.with_views("trips", "SELECT destination, count(*) AS trips FROM trips WHERE destination IS NOT NULL GROUP BY destination"))
def agg_dest_counts(spark, sf_dir):
    return views.trips(spark, sf_dir).where("destination IS NOT NULL").groupBy("destination").agg(F.count("*").alias("trips"))


#: Trip records of an engine: some name their origin, some leave it to the demand.
_RECORDS = ", rec AS (SELECT trip_id, CASE WHEN departure_time_s % 3 = 0 THEN origin END AS own, CAST(departure_time_s % 1000 AS DOUBLE) AS duration, CAST(departure_time_s % 77 AS DOUBLE) AS distance FROM trips), dm AS (SELECT trip_id, CASE WHEN departure_time_s % 5 <> 0 THEN origin END AS origin FROM trips) "


def _records(spark, sf_dir):
    trips = views.trips(spark, sf_dir)
    rows = trips.selectExpr("trip_id", "CASE WHEN departure_time_s % 3 = 0 THEN origin END AS own", "CAST(departure_time_s % 1000 AS DOUBLE) AS duration", "CAST(departure_time_s % 77 AS DOUBLE) AS distance")
    looked = trips.selectExpr("trip_id", "CASE WHEN departure_time_s % 5 <> 0 THEN origin END AS origin")
    return rows.join(looked, "trip_id", "left").withColumn("origin", F.coalesce("own", "origin")).where("origin IS NOT NULL")


@query("join_trip_origin", views.with_views("trips", _RECORDS + "SELECT trip_id, coalesce(own, origin) AS origin FROM rec LEFT JOIN dm USING (trip_id) WHERE coalesce(own, origin) IS NOT NULL").replace(" , rec AS", ", rec AS"))
def join_trip_origin(spark, sf_dir):
    return _records(spark, sf_dir).select("trip_id", "origin")


for _name in ("agg_trips_by_origin", "agg_mean_duration"):

    @query(_name, views.with_views("trips", _RECORDS + "SELECT coalesce(own, origin) AS origin, count(*) AS trips, sum(duration) AS duration, sum(distance) AS distance, round(coalesce(sum(duration) / nullif(count(*), 0), 0), 6) AS mean_duration FROM rec LEFT JOIN dm USING (trip_id) WHERE coalesce(own, origin) IS NOT NULL GROUP BY 1").replace(" , rec AS", ", rec AS"))
    def _by_origin(spark, sf_dir):
        by = _records(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("trips"), F.sum("duration").alias("duration"), F.sum("distance").alias("distance"))
        return by.withColumn("mean_duration", numbers.rounded(F.coalesce(F.try_divide("duration", "trips"), F.lit(0.0)), 6))


_AGREE = ", us AS (SELECT link, count(DISTINCT engine) AS engines FROM link_counts WHERE n > 12 GROUP BY link)"


@query("agg_agreement", views.with_views("link_counts", _AGREE + " SELECT link, engines FROM us"))
def agg_agreement(spark, sf_dir):
    return views.link_counts(spark, sf_dir).where("n > 12").groupBy("link").agg(F.count_distinct("engine").alias("engines"))


for _name in ("join_agreement", "map_diversity"):

    @query(_name, views.with_views("link_counts", _AGREE + " SELECT link, least(coalesce(engines, 0), 3) AS class FROM (SELECT DISTINCT link FROM link_counts) LEFT JOIN us USING (link)"))
    def _classes(spark, sf_dir):
        counts = views.link_counts(spark, sf_dir)
        used = counts.where("n > 12").groupBy("link").agg(F.count_distinct("engine").alias("engines"))
        return counts.select("link").distinct().join(used, "link", "left").select("link", F.least(F.coalesce("engines", F.lit(0)), F.lit(3)).alias("class"))


for _name in ("map_link", "win_link_scene"):

    @query(_name, views.with_views("link_counts", ", m AS (SELECT min(n) AS a, max(n) AS b FROM link_counts) SELECT engine, link, n, round(CASE WHEN a = b THEN 1.75 ELSE 0.5 + 2.5 * sqrt((n - a) / (b - a)) END, 6) AS width FROM link_counts, m"))
    def _widths(spark, sf_dir):
        from corridor.functions.geo import scaled_width

        counts = views.link_counts(spark, sf_dir)
        ends = counts.agg(F.min("n").alias("a"), F.max("n").alias("b"))  # one row
        return rounded(counts.crossJoin(F.broadcast(ends)).select("engine", "link", "n", scaled_width(F.col("n"), F.col("a"), F.col("b"), 0.5, 3.0).alias("width")), 6)


@query("map_flow", views.with_views("link_events", "SELECT t // 86400000000 AS day, link, count(*) AS n FROM link_events WHERE type = 'entered' GROUP BY ALL"))
def map_flow(spark, sf_dir):
    rows = views.link_events(spark, sf_dir).where("type = 'entered'")
    return rows.groupBy(F.floor(F.col("t") / 86_400_000_000).alias("day"), "link").agg(F.count("*").alias("n"))


_STAY = "v AS (SELECT veh, link, t_in, t AS t_out FROM (SELECT *, lag(type) OVER w AS before, lag(t) OVER w AS t_in FROM link_events WINDOW w AS (PARTITION BY veh, link ORDER BY t, pos)) WHERE type = 'left' AND before = 'entered' AND t > t_in)"


@query("map_particles", views.with_views("link_events", f", {_STAY}, f AS (SELECT DISTINCT t // 86400000000 * 86400000000 AS t FROM link_events) SELECT f.t, veh, link, round((f.t - t_in) / (t_out - t_in), 6) AS progress FROM f JOIN v ON f.t BETWEEN t_in AND t_out").replace(" , v AS", ", v AS"))
def map_particles(spark, sf_dir):
    from corridor.operators import events

    rows, day = views.link_events(spark, sf_dir), 86_400_000_000
    frames = rows.select((F.floor(F.col("t") / day) * day).alias("t")).distinct()
    return rounded(events.positions_at(events.visits(rows), frames, day), 6)


@query("set_union_am_pm", views.with_views("trips", "SELECT purpose, count(*) AS trips FROM trips WHERE purpose LIKE '%chained' OR purpose LIKE 'HBSchool%' GROUP BY purpose"))
def set_union_am_pm(spark, sf_dir):
    return views.trips(spark, sf_dir).where(F.col("purpose").isin(*demand.CHAINED)).groupBy("purpose").agg(F.count("*").alias("trips"))


@query("win_trip_id_synth", views.with_views("trips", "SELECT trip_id, 't' || (row_number() OVER (ORDER BY departure_time_s, CAST(substr(trip_id, 2) AS BIGINT)) - 1) AS new_id FROM trips"))
def win_trip_id_synth(spark, sf_dir):
    rows = views.trips(spark, sf_dir).withColumn("pos", F.substring("trip_id", 2, 20).cast("long"))
    found = ranges.numbered(rows, ["departure_time_s", "pos"], F.col("departure_time_s"), "k")
    return found.select("trip_id", F.concat(F.lit("t"), "k").alias("new_id"))


@query("win_ecdf", views.with_views("trip_times", "SELECT DISTINCT tt, CAST(count(*) OVER (ORDER BY tt) AS BIGINT) AS upto FROM trip_times WHERE engine = 'F'"))
def win_ecdf(spark, sf_dir):
    counts = views.trip_times(spark, sf_dir).where("engine = 'F'").groupBy("tt").agg(F.count("*").alias("w"))
    return ranges.running_sums(counts, [], "tt", ["w"]).select("tt", F.col("w_upto").alias("upto"))


#: A uniform number of a key and a draw, as the generators make it.
_U = "(('0x' || substr(md5('{seed}|' || {key} || '|{draw}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _u(key, draw, seed=42):
    return _U.format(seed=seed, key=key, draw=draw)


_CDF = "cdf AS (SELECT node, idx, sum(w) OVER (ORDER BY idx) - w AS lo, sum(w) OVER (ORDER BY idx) AS hi, sum(w) OVER () AS total FROM items)"
_ITEMS = "items AS (SELECT 'n' || c_custkey AS node, CAST(c_custkey AS BIGINT) AS idx, CAST(c_custkey % 5 AS BIGINT) AS w FROM customer)"


def _items(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").selectExpr("'n' || c_custkey AS node", "CAST(c_custkey AS BIGINT) AS idx", "CAST(c_custkey % 5 AS BIGINT) AS w")


@query("win_cumsum_sample", f"WITH {_ITEMS}, {_CDF} SELECT o_orderkey AS k, node FROM orders, cdf WHERE floor({_u('o_orderkey', 'x')} * total) >= lo AND floor({_u('o_orderkey', 'x')} * total) < hi")
def win_cumsum_sample(spark, sf_dir):
    draws = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("u", generate.uniform(42, F.col("k"), "x"))
    return generate.pick(draws, "u", _items(spark, sf_dir), "node").select("k", "node")


#: Nodes that a generator draws from: customers, with degree and place.
_NODES = "nodes AS (SELECT 'n' || c_custkey AS node, CAST(c_custkey AS BIGINT) AS idx, CAST(c_custkey % 5 + 1 AS BIGINT) AS degree, 40 + (c_custkey * 37 % 1000) / 10000.0::DOUBLE AS lat, -80 + (c_custkey * 91 % 1000) / 10000.0::DOUBLE AS lon FROM customer)"


def _nodes(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").selectExpr("'n' || c_custkey AS node", "CAST(c_custkey AS BIGINT) AS idx", "CAST(c_custkey % 5 + 1 AS BIGINT) AS degree", "40 + (c_custkey * 37 % 1000) / 10000.0D AS lat", "-80 + (c_custkey * 91 % 1000) / 10000.0D AS lon")


#: Places that trips go between: the largest component's nodes with their degrees.
_PLACES = (
    ", deg AS (SELECT node, count(*) AS degree FROM (SELECT from_node AS node FROM links UNION ALL SELECT to_node FROM links) GROUP BY node), num AS (SELECT node, CAST(substr(node, 2) AS BIGINT) AS idx, degree FROM scc JOIN deg USING (node)), "
    "places AS (SELECT node, idx, degree, 40 + (idx * 37 % 1000) / 10000.0::DOUBLE AS lat, -80 + (idx * 91 % 1000) / 10000.0::DOUBLE AS lon, degree + 1 AS m0, 1 AS m1, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS n FROM num)"
)


def _place_ids(spark, sf_dir):
    """The places without their degrees, which every node of the component has."""
    return component(spark, sf_dir).withColumn("idx", F.substring("node", 2, 20).cast("long"))


def _places(spark, sf_dir):
    rows = component(spark, sf_dir).join(network.degree(views.links(spark, sf_dir)), "node").withColumn("idx", F.substring("node", 2, 20).cast("long"))
    return rows.selectExpr("node", "idx", "degree", "40 + (idx * 37 % 1000) / 10000.0D AS lat", "-80 + (idx * 91 % 1000) / 10000.0D AS lon")


def _placed_sql(select):
    return _recursive(views.with_views("links", _SCC + _PLACES + select)).replace(" , deg AS", ", deg AS")


def _order_keys(spark, sf_dir):
    """A trip an order."""
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))


_UNIFORM = (
    f", keys AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders), ends2 AS (SELECT k, floor({_u('k', 'origin')} * n) AS o, floor({_u('k', 'destination')} * (n - 1)) AS d FROM keys, (SELECT count(*) AS n FROM places) WHERE n > 1), "
    "pr AS (SELECT k, a.node AS origin, b.node AS destination FROM ends2 JOIN places a ON a.pos = o JOIN places b ON b.pos = CASE WHEN d >= o THEN d + 1 ELSE d END) "
)


for _name in ("gen_uniform_od", "gen_peak_od"):

    @query(_name, _placed_sql(_UNIFORM + "SELECT k, origin, destination FROM pr"))
    def _uniform(spark, sf_dir):
        return generate.uniform_pairs(_order_keys(spark, sf_dir), _place_ids(spark, sf_dir), 42)


@query("gen_gravity_init", f"WITH {_NODES} SELECT node, round((degree + 1) / (SELECT sum(degree) FROM nodes), 12) AS weight FROM nodes")
def gen_gravity_init(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return nodes.crossJoin(F.broadcast(nodes.agg(F.sum("degree").alias("s")))).select("node", numbers.rounded((F.col("degree") + 1) / F.col("s"), 12).alias("weight"))


_PULL_SQL = "1 / (pow({}, 1.0::DOUBLE) + 0.1::DOUBLE)"
_GRAVITY = (
    f", keys AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), pull AS (SELECT node, lat, lon, sum(m0) OVER (ORDER BY idx) - m0 AS lo, sum(m0) OVER (ORDER BY idx) AS hi, sum(m0) OVER () AS total FROM places), "
    f"draws AS (SELECT k, node AS origin, lat, lon, (SELECT 1.0::DOUBLE / greatest(sum(degree), 1) FROM places) AS per_degree FROM keys JOIN pull ON floor({_u('k', 'origin')} * total) >= lo AND floor({_u('k', 'origin')} * total) < hi), "
    + draws.sql(
        ["k", "origin", "lat", "lon", "per_degree"],
        ["CASE WHEN {far} < 0.5 OR {near} > 10 THEN 0 ELSE " + _PULL_SQL.format("greatest({near}, 0.5)") + " END", "CASE WHEN {near} >= 0.5 AND {far} <= 10 THEN 0 ELSE 0.01::DOUBLE END"],
        ["CASE WHEN km BETWEEN 0.5 AND 10 THEN " + _PULL_SQL.format("km") + " ELSE 0 END", "CASE WHEN km BETWEEN 0.5 AND 10 THEN 0 ELSE 0.01::DOUBLE END"],
        ["per_degree", "1.0::DOUBLE"],
        _u,
    )
    + " SELECT k, origin, destination FROM walk WHERE destination IS NOT NULL"
)


@query("gen_gravity_od", _placed_sql(_GRAVITY))
def gen_gravity_od(spark, sf_dir):
    keys = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return generate.gravity_pairs(keys, _places(spark, sf_dir), 42)


_LEAVE = (
    f"CAST(floor(CASE WHEN {_u('k', 'share')} < 0.7 AND {_u('k', 'peak')} < 0.5 THEN 25200 + {_u('k', 'time')} * 7200 WHEN {_u('k', 'share')} < 0.7 AND {_u('k', 'peak')} >= 0.5 THEN 61200 + {_u('k', 'time')} * 3800 ELSE 20000 + {_u('k', 'time')} * 45000 END) AS INTEGER)"
)


@query("gen_peak_departure", f"SELECT k, {_LEAVE} AS departure_time_s FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)")
def gen_peak_departure(spark, sf_dir):
    return _order_keys(spark, sf_dir).select("k", generate.peak_departure(42, F.col("k"), 20_000, 65_000).alias("departure_time_s"))


for _name in ("gen_trips", "gen_synthetic"):

    @query(_name, _placed_sql(_UNIFORM + f", dp AS (SELECT *, {_LEAVE} AS departure_time_s FROM pr) SELECT 't' || (row_number() OVER (ORDER BY departure_time_s, k) - 1) AS trip_id, origin, destination, departure_time_s, 'car' AS mode FROM dp"))
    def _trips(spark, sf_dir):
        # all trips are made or none, so they are numbered before they get their ends
        trips = _order_keys(spark, sf_dir).withColumn("departure_time_s", generate.peak_departure(42, F.col("k"), 20_000, 65_000))
        trips = ranges.numbered(trips, ["departure_time_s", "k"], F.col("departure_time_s"), "n")
        found = generate.uniform_pairs(trips, _place_ids(spark, sf_dir), 42)
        return found.select(F.concat(F.lit("t"), "n").alias("trip_id"), "origin", "destination", "departure_time_s", F.lit("car").alias("mode"))


@query("gen_peak_split", "SELECT o_orderkey AS k, CASE WHEN a AND p THEN n // 2 WHEN p THEN 0 ELSE n END AS am, CASE WHEN a AND p THEN n - n // 2 WHEN p THEN n ELSE 0 END AS pm FROM (SELECT *, 28800 BETWEEN s AND e AS a, 61200 BETWEEN s AND e AS p FROM (SELECT o_orderkey, o_custkey AS n, o_orderkey % 50000 AS s, o_orderkey % 50000 + 30000 AS e FROM orders))")
def gen_peak_split(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS n", "o_orderkey % 50000 AS s", "o_orderkey % 50000 + 30000 AS e")
    return rows.select("k", *(c.cast("long").alias(k) for k, c in generate.peak_split(F.col("n"), F.col("s"), F.col("e")).items()))


#: Scheduled people: customers with a home, a work place, some with a school.
_PEOPLE = ["CAST(c_custkey AS BIGINT) AS id", "'n' || c_custkey AS home", "'n' || (c_custkey % 300 + 1) AS work", "CASE WHEN c_custkey % 4 = 0 THEN 'n' || (c_custkey % 40 + 1) END AS school", "CAST(c_custkey % 80 AS INT) AS commute_min", "'car' AS mode", "CAST(c_custkey * 7919 % 100003 AS BIGINT) * 100000000 + c_custkey AS place"]


def _people(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").selectExpr(*_PEOPLE)


_BUDGET = f"pp AS (SELECT {', '.join(_PEOPLE)} FROM customer), bg AS (SELECT *, CASE WHEN school <> home AND school <> work THEN 2 ELSE 1 END AS cost, coalesce(sum(CASE WHEN school <> home AND school <> work THEN 2 ELSE 1 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM pp), gr AS (SELECT *, CAST(CASE WHEN prior + cost <= 100 THEN cost ELSE 1 END AS INTEGER) AS granted FROM bg WHERE prior < 100)"


@query("lim_budget", f"WITH {_BUDGET} SELECT id, granted FROM gr")
def lim_budget(spark, sf_dir):
    rows = _people(spark, sf_dir).withColumn("cost", F.when(F.expr("school <> home AND school <> work"), 2).otherwise(1))
    return generate.within_budget(rows, "place", "cost", 100).select("id", F.col("granted").cast("int").alias("granted"))


def _schedule_sql(a, b, plain, first, second, arrival):
    leave = f"CAST(greatest(21600, least(79999, {arrival} - commute_min * 60)) AS INTEGER)"
    row = lambda leg, o, d, p, g: f"SELECT id, {leg} AS leg, {o} AS origin, {d} AS destination, '{p}' AS purpose, {leave} AS departure_time_s, mode, 'schedule' AS dest_source FROM gr WHERE granted {g}"
    return f"WITH {_BUDGET} " + " UNION ALL ".join((row(0, a, b, plain, "= 1"), row(0, a, "school", first, "= 2"), row(1, "school", b, second, "= 2")))


@query("gen_schedule_am", _schedule_sql("home", "work", "HBW_AM", "HBSchool_AM", "HBW_AM_chained", 28_800))
def gen_schedule_am(spark, sf_dir):
    return generate.schedule_trips(_people(spark, sf_dir), 100, True, 21_600, 80_000)


@query("gen_schedule_pm", _schedule_sql("work", "home", "HBW_PM", "HBW_PM_chained", "HBSchool_PM", 61_200))
def gen_schedule_pm(spark, sf_dir):
    return generate.schedule_trips(_people(spark, sf_dir), 100, False, 21_600, 80_000)


#: People who live, work and go to school at places; every ninth has no work place, so no schedule.
_CROWD = ["CAST(c_custkey AS BIGINT) AS id", "c_custkey % 9 <> 1 AS works", "c_custkey % 4 = 0 AS parent", "CAST(c_custkey % 80 AS INT) AS commute_min", "CASE WHEN c_custkey % 3 = 0 THEN 'bike' ELSE 'car' END AS mode", "CAST(c_custkey * 7919 % 100003 AS BIGINT) * 100000000 + c_custkey AS place"]
_CROWD_SQL = (
    f", pp AS (SELECT c.*, h.node AS home, CASE WHEN works THEN w.node END AS work, CASE WHEN parent THEN s.node END AS school FROM (SELECT {', '.join(_CROWD)} FROM customer) c "
    "JOIN places h ON h.pos = c.id % h.n JOIN places w ON w.pos = c.id * 7 % w.n JOIN places s ON s.pos = c.id * 3 % s.n)"
)


def _crowd(spark, sf_dir):
    placed = ranges.numbered(_places(spark, sf_dir).select("node", "idx"), ["idx"], F.floor(F.col("idx") / 1000), "pos")
    rows = views.table(spark, sf_dir, "customer").selectExpr(*_CROWD).crossJoin(F.broadcast(placed.agg(F.count("*").alias("n"))))  # one row
    for name, times in (("home", 1), ("work", 7), ("school", 3)):
        rows = rows.withColumn("pos", F.col("id") * times % F.col("n")).join(placed.select("pos", F.col("node").alias(name)), "pos")
    return rows.select("id", "home", F.when(F.col("works"), F.col("work")).alias("work"), F.when(F.col("parent"), F.col("school")).alias("school"), "commute_min", "mode", "place")


def _fallback_sql(am, pm):
    """Drawn trips of ``am`` mornings and ``pm`` afternoons."""
    bell = "exp(pow(({0} - goal) / (goal * 0.7::DOUBLE + 0.5::DOUBLE), 2.0::DOUBLE) * -0.5::DOUBLE)"
    leave = "CAST(greatest(21600, least(79999, {} - commute_min * 60)) AS INTEGER)"
    return (
        f", want AS (SELECT {am} AS am, {pm} AS pm), ks AS (SELECT k, k < am AS morning FROM (SELECT am, unnest(range(0, am + pm)) AS k FROM want)), rk AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS spot, count(*) OVER () AS crowd FROM pp), "
        f"who AS (SELECT k, morning, rk.* FROM ks JOIN rk ON spot = floor({_u('k', 'person')} * crowd)), draws AS (SELECT k, home AS origin, lat, lon, greatest(0.5::DOUBLE, least(15.0::DOUBLE, commute_min * 0.5::DOUBLE)) AS goal FROM who JOIN places ON node = home), "
        + draws.sql(
            ["k", "origin", "lat", "lon", "goal"],
            ["CASE WHEN {far} < 0.1 THEN 0 ELSE " + bell.format("least(greatest(goal, {near}, 0.1), greatest({far}, 0.1))") + " END", "0.0::DOUBLE"],
            ["CASE WHEN km >= 0.1 THEN " + bell.format("km") + " ELSE 0 END", "0.0::DOUBLE"],
            ["1.0::DOUBLE", "1.0::DOUBLE"],
            _u,
        )
        + ", gf AS (SELECT id, k, CASE WHEN morning THEN origin ELSE destination END AS origin, CASE WHEN morning THEN destination ELSE origin END AS destination, CASE WHEN morning THEN 'HBW_AM' ELSE 'HBW_PM' END AS purpose, "
        f"CASE WHEN morning THEN {leave.format(28_800)} ELSE {leave.format(61_200)} END AS departure_time_s, mode, 'gravity' AS dest_source FROM walk JOIN who USING (k) WHERE destination IS NOT NULL) "
    )


@query("gen_gravity_fallback", _placed_sql(_CROWD_SQL + _fallback_sql("(SELECT count(*) // 2 FROM customer)", "(SELECT count(*) - count(*) // 2 FROM customer)") + "SELECT * FROM gf"))
def gen_gravity_fallback(spark, sf_dir):
    n = views.table(spark, sf_dir, "customer").count()
    return generate.fallback_trips(_crowd(spark, sf_dir), _places(spark, sf_dir), n // 2, n - n // 2, 42, 21_600, 80_000)


def _leg_sql(budget, morning):
    """Trips of scheduled people within a budget."""
    a, b = ("home", "work") if morning else ("work", "home")
    plain, first, second = ("HBW_AM", "HBSchool_AM", "HBW_AM_chained") if morning else ("HBW_PM", "HBW_PM_chained", "HBSchool_PM")
    t = "am" if morning else "pm"
    leave = f"CAST(greatest(21600, least(79999, {28_800 if morning else 61_200} - commute_min * 60)) AS INTEGER)"
    row = lambda o, d, p, g: f"SELECT {o} AS origin, {d} AS destination, '{p}' AS purpose, {leave} AS departure_time_s, mode, 'schedule' AS dest_source FROM g{t} WHERE granted {g}"
    return (
        f", r{t} AS (SELECT *, cost + coalesce(sum(cost) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM (SELECT *, CASE WHEN school <> home AND school <> work THEN 2 ELSE 1 END AS cost FROM pp WHERE work <> home)), "
        f"g{t} AS (SELECT *, CASE WHEN upto <= {budget} THEN cost ELSE 1 END AS granted FROM r{t} WHERE upto - cost < {budget}), s{t} AS ({row(a, b, plain, '= 1')} UNION ALL {row(a, 'school', first, '= 2')} UNION ALL {row('school', b, second, '= 2')})"
    )


_HALVES = ("(SELECT count(*) * 3 // 2 FROM customer)", "(SELECT count(*) * 3 - count(*) * 3 // 2 FROM customer)")


@query(
    "gen_census",
    _placed_sql(
        _CROWD_SQL + _leg_sql(_HALVES[0], True) + _leg_sql(_HALVES[1], False) + _fallback_sql(f"greatest(0, {_HALVES[0]} - (SELECT count(*) FROM sam))", f"greatest(0, {_HALVES[1]} - (SELECT count(*) FROM spm))")
        + "SELECT * FROM sam UNION ALL SELECT * FROM spm UNION ALL SELECT origin, destination, purpose, departure_time_s, mode, dest_source FROM gf"
    ),
)
def gen_census(spark, sf_dir):
    n = 3 * views.table(spark, sf_dir, "customer").count()
    return generate.census_trips(_crowd(spark, sf_dir), _places(spark, sf_dir), n // 2, n - n // 2, 42, 21_600, 80_000)


@query("gen_school_array", f"WITH {_NODES} SELECT node, lat, lon FROM nodes WHERE idx % 6 IN (0, 4)")
def gen_school_array(spark, sf_dir):
    kinds = _nodes(spark, sf_dir).withColumn("kind", F.expr("CASE idx % 6 WHEN 0 THEN 'school:' WHEN 4 THEN 'College:x' ELSE 'house' END"))
    return kinds.where(roads.is_school(F.col("kind"))).select("node", "lat", "lon")


@query("agg_avg_commute", f"WITH pp AS (SELECT {', '.join(_PEOPLE)} FROM customer) SELECT mode, round(coalesce(avg(commute_min) FILTER (commute_min > 0), 30), 6) AS minutes FROM pp GROUP BY mode")
def agg_avg_commute(spark, sf_dir):
    mean = F.avg(F.when(F.col("commute_min") > 0, F.col("commute_min")))
    return _people(spark, sf_dir).groupBy("mode").agg(numbers.rounded(F.coalesce(mean, F.lit(30.0)), 6).alias("minutes"))


@query("agg_provenance", views.with_views("trips", "SELECT count(*) FILTER (purpose LIKE '%chained') AS schedule, count(*) FILTER (purpose NOT LIKE '%chained') AS gravity, count(*) FILTER (purpose LIKE '%\\_AM%' ESCAPE '\\') AS am, count(*) FILTER (purpose LIKE '%\\_PM%' ESCAPE '\\') AS pm, count(*) FILTER (purpose LIKE 'HBSchool%') AS chains FROM trips"))
def agg_provenance(spark, sf_dir):
    n = lambda cond: F.count(F.when(cond, 1))
    p = F.col("purpose")
    return views.trips(spark, sf_dir).agg(n(p.endswith("chained")).alias("schedule"), n(~p.endswith("chained")).alias("gravity"), n(p.isin(*demand.AM)).alias("am"), n(p.isin(*demand.PM)).alias("pm"), n(p.startswith("HBSchool")).alias("chains"))


#: People's buildings at nodes: some homes and work places lie at none, or outside the component.
_OD = f"WITH {_NODES}, pp AS (SELECT {', '.join(_PEOPLE)} FROM customer), od AS (SELECT id, h.node AS home_node, w.node AS work_node, CASE WHEN school IS NULL AND id % 9 = 1 THEN 'no_schedule' WHEN h.node IS NULL THEN 'home_not_mapped' WHEN w.node IS NULL THEN 'work_not_mapped' WHEN h.node = w.node THEN 'same_node' ELSE 'ok' END AS reason FROM pp LEFT JOIN nodes h ON home = h.node AND h.idx % 11 <> 0 LEFT JOIN nodes w ON work = w.node AND w.idx % 13 <> 0) "


def _schedule_od(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    homes = nodes.where("idx % 11 <> 0").select(F.col("node").alias("home"), F.col("node").alias("home_node"))
    works = nodes.where("idx % 13 <> 0").select(F.col("node").alias("work"), F.col("node").alias("work_node"))
    rows = _people(spark, sf_dir).join(homes, "home", "left").join(works, "work", "left")
    reason = (
        F.when(F.col("school").isNull() & (F.col("id") % 9 == 1), "no_schedule").when(F.col("home_node").isNull(), "home_not_mapped")
        .when(F.col("work_node").isNull(), "work_not_mapped").when(F.col("home_node") == F.col("work_node"), "same_node").otherwise("ok")
    )
    return rows.select("id", "home_node", "work_node", reason.alias("reason"))


@query("join_schedule_od", _OD + "SELECT id, home_node, work_node, reason FROM od")
def join_schedule_od(spark, sf_dir):
    return _schedule_od(spark, sf_dir)


@query("agg_fallback_reasons", _OD + "SELECT reason, count(*) AS people FROM od WHERE reason <> 'ok' GROUP BY reason")
def agg_fallback_reasons(spark, sf_dir):
    return _schedule_od(spark, sf_dir).where("reason <> 'ok'").groupBy("reason").agg(F.count("*").alias("people"))


@query("join_restriction_links", views.with_views("links", ", w AS (SELECT *, link_pos % 40 AS way FROM links), i AS (SELECT way, to_node AS node, arg_min(link_id, link_pos) AS from_link FROM w GROUP BY ALL), o AS (SELECT way, from_node AS node, arg_min(link_id, link_pos) AS to_link FROM w GROUP BY ALL), r AS (SELECT DISTINCT to_node AS node, way AS from_way, (way + 1) % 40 AS to_way FROM w) SELECT r.node, from_way, to_way, from_link, to_link FROM r JOIN i ON i.way = from_way AND i.node = r.node JOIN o ON o.way = to_way AND o.node = r.node").replace(" , w AS", ", w AS"))
def join_restriction_links(spark, sf_dir):
    ways = views.links(spark, sf_dir).withColumn("way", F.col("link_pos") % 40)
    rules = ways.select(F.col("to_node").alias("node"), F.col("way").alias("from_way"), ((F.col("way") + 1) % 40).alias("to_way")).distinct()
    first = lambda end, way, name: ways.groupBy(F.col("way").alias(way), F.col(end).alias("node")).agg(F.min_by("link_id", "link_pos").alias(name))
    return rules.join(first("to_node", "from_way", "from_link"), ["node", "from_way"]).join(first("from_node", "to_way", "to_link"), ["node", "to_way"])


@query("agg_sha256", "SELECT o_orderpriority AS scenario, sha256(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus)) AS hash FROM orders GROUP BY 1")
def agg_sha256(spark, sf_dir):
    parts = F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",")  # names of a scenario's files
    return views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(F.sha2(parts, 256).alias("hash"))


@query("agg_cache_key", views.with_views("trips", "SELECT mode, sha256(count(*) || ':' || CAST(sum(('0x' || substr(md5(trip_id), 1, 8))::BIGINT) AS BIGINT)) AS key FROM trips GROUP BY mode"))
def agg_cache_key(spark, sf_dir):
    # of a set of any size: counts and sums of the ids' hashes, which tasks add up
    own = F.conv(F.substring(F.md5("trip_id"), 1, 8), 16, 10).cast("bigint")
    return views.trips(spark, sf_dir).groupBy("mode").agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(own)), 256).alias("key"))


#: Plans of the runs: a cell's repeats are its seeds.
_PLAN = views.with_views("runs", ", pl AS (SELECT scenario, CASE engine WHEN 'F' THEN 'sumo' ELSE 'matsim' END AS engine, mode, count(DISTINCT seed) AS repeats, min(seed) AS seed FROM runs GROUP BY ALL) SELECT scenario, engine, mode, CAST(seed + i AS INTEGER) AS seed FROM pl, (SELECT unnest(range(0, (SELECT max(repeats) FROM pl))) AS i) WHERE i < repeats").replace(" , pl AS", ", pl AS")


def _plan(spark, sf_dir):
    engine = F.when(F.col("engine") == "F", "sumo").otherwise("matsim")
    mode = F.when(F.col("mode") == "meso", "mesoscopic").otherwise("microscopic")
    by = views.runs(spark, sf_dir).groupBy("scenario", engine.alias("engine"), mode.alias("mode"))
    return by.agg(F.count_distinct("seed").cast("int").alias("repeats"), F.min("seed").cast("int").alias("seed"))


@query("src_runspec", _PLAN)
def src_runspec(spark, sf_dir):
    path = f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}"
    _plan(spark, sf_dir).write.json(path)
    return runspec.read(spark, path)


@query("src_runspec_dict", _PLAN)
def src_runspec_dict(spark, sf_dir):
    return runspec.matrix(spark, {"scenarios": [r.asDict() for r in _plan(spark, sf_dir).collect()]})  # a row a cell


@query("src_city_bbox", "SELECT lower(n_name) AS city, (400 + n_nationkey + 5) / 10.0::DOUBLE AS north, (400 + n_nationkey) / 10.0::DOUBLE AS south, (n_nationkey - 800 + 7) / 10.0::DOUBLE AS east, (n_nationkey - 800) / 10.0::DOUBLE AS west FROM nation")
def src_city_bbox(spark, sf_dir):
    path = f"{shared_dir(spark)}/cities-{uuid.uuid4().hex}"
    side = lambda n: F.format_string("%.1f", n / 10)
    k = F.col("n_nationkey")
    box = F.concat_ws(",", side(k + 405), side(k + 400), side(k - 793), side(k - 800))
    views.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("city"), box.alias("box")).write.json(path)
    rows = spark.read.schema("city string, box string").json(path).withColumn("p", F.split("box", ","))
    return rows.select("city", *(F.col("p")[i].cast("double").alias(k) for i, k in enumerate(("north", "south", "east", "west"))))
