"""Queries on files: each writes its files to the shared folder with a sink and reads them back with a source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corridor import views
from corridor.functions import numbers, roads
from corridor.operators import ranges, reports, signals, statistics
from corridor.plans.statistics import _CELLS
from corridor.registry import query
from corridor.session import materialise, shared_dir
from corridor.sinks import files as out
from corridor.sinks import lines as doc
from corridor.sources import cells
from corridor.sources import files as src

#: Nodes and links with all attributes, in Spark's SQL and DuckDB's alike.
_NODES = ["'n' || CAST(id AS STRING) AS node", "CAST(id AS DOUBLE) / 10 AS x", "CAST(id * 7 % 100 AS DOUBLE) AS y", "CASE id % 3 WHEN 0 THEN 'dead_end' ELSE 'intersection' END AS type", "CASE WHEN id % 2 = 0 THEN CAST(id * 11 AS STRING) END AS osm_id", "id % 5 = 0 AS has_signal"]
_LINKS = [
    "link_id", "link_pos", "CASE WHEN link_pos % 13 = 0 THEN to_node ELSE from_node END AS from_node", "to_node", "CASE WHEN link_pos % 11 = 0 THEN 0.25 ELSE length END AS length", "CAST(link_pos % 4 AS INT) AS lanes",
    "CAST(link_pos % 30 AS DOUBLE) / 2 AS speed", "CASE link_pos % 3 WHEN 0 THEN 'primary' ELSE 'service' END AS road", "CASE link_pos % 3 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '77' END AS osm_way_id",
    "CASE WHEN link_pos % 4 = 0 THEN 'A & \"B\" <' || link_id || '>' END AS name",
]
_RULES = ["CASE link_pos % 3 WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'only_straight_on' ELSE 'no_entry' END AS type", "link_id AS from_link", "to_node AS via_node", "'l' || CAST(link_pos + 1 AS STRING) AS to_link"]
_NET = (
    f", nd AS (SELECT {', '.join(_NODES)} FROM (SELECT c_custkey AS id FROM customer)), lk AS (SELECT {', '.join(_LINKS)} FROM links), tr AS (SELECT {', '.join(_RULES)} FROM links WHERE link_pos % 6 = 0) "
)
_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _nodes(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).selectExpr(*_NODES)


def _links(spark, sf_dir):
    return views.links(spark, sf_dir).selectExpr(*_LINKS)


def _rules(spark, sf_dir):
    return views.links(spark, sf_dir).where("link_pos % 6 = 0").selectExpr(*_RULES)


def _net_sql(select):
    return views.with_views("links", _NET + select)


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _network(spark, sf_dir):
    """The path of a network file with all that a reader may meet."""
    path = _path(spark, "network")
    doc.write(out.network_xml(_nodes(spark, sf_dir), _links(spark, sf_dir), _rules(spark, sf_dir), "EPSG:4326"), path)
    return path


def _document(name, sql):
    """A query that writes a document and gives its lines."""

    def keep(build):
        def run(spark, sf_dir):
            path = _path(spark, name)
            doc.write(build(spark, sf_dir), path)
            return doc.read(spark, path)

        return query(name, sql)(run)

    return keep


def _fixed(*lines):
    return "SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]) AS line "


_ATTR = lambda k, v: f"coalesce(' {k}=\"' || {v} || '\"', '')"


@_document(
    "snk_network_xml",
    _net_sql(
        _fixed("<network>", '  <metadata crs="EPSG:4326" units_length="meters" units_speed="m/s" source="OSM"/>', "  <nodes>", "  </nodes>", "  <links>", "  </links>", "  <turn_restrictions>", "  </turn_restrictions>", "</network>")
        + "UNION ALL SELECT '    <node id=\"' || node || '\" x=\"' || x || '\" y=\"' || y || '\" type=\"' || type || '\"' || " + _ATTR("osm_id", "osm_id") + " || CASE WHEN has_signal THEN ' has_signal=\"true\"' ELSE '' END || '/>' FROM nd "
        "UNION ALL SELECT '    <link id=\"' || link_id || '\" from=\"' || from_node || '\" to=\"' || to_node || '\" length=\"' || round_even(length, 2) || '\" lanes=\"' || lanes || '\" speed_limit=\"' || speed || '\" highway_type=\"' || road || '\"' || "
        + _ATTR("osm_way_id", "osm_way_id") + " || " + _ATTR("name", _ESC.format("name")) + " || '/>' FROM lk "
        "UNION ALL SELECT '    <turn_restriction type=\"' || type || '\" from_link=\"' || from_link || '\" via_node=\"' || via_node || '\" to_link=\"' || to_link || '\"/>' FROM tr"
    ),
)
def snk_network_xml(spark, sf_dir):
    return out.network_xml(_nodes(spark, sf_dir), _links(spark, sf_dir), _rules(spark, sf_dir), "EPSG:4326")


_XML = '<?xml version="1.0" encoding="UTF-8"?>'


@_document("snk_sumo_nodes", _net_sql(_fixed(_XML, "<nodes>", "</nodes>") + "UNION ALL SELECT '    <node id=\"' || node || '\" x=\"' || x || '\" y=\"' || y || '\" type=\"priority\"/>' FROM nd"))
def snk_sumo_nodes(spark, sf_dir):
    return out.sumo_nodes(_nodes(spark, sf_dir))


@_document("snk_sumo_edges", _net_sql(_fixed(_XML, "<edges>", "</edges>") + "UNION ALL SELECT printf('    <edge id=\"%s\" from=\"%s\" to=\"%s\" numLanes=\"%d\" speed=\"%s\" length=\"%.2f\"/>', link_id, from_node, to_node, lanes, CAST(speed AS VARCHAR), length) FROM lk WHERE from_node <> to_node"))
def snk_sumo_edges(spark, sf_dir):
    return out.sumo_edges(_links(spark, sf_dir))


@_document(
    "snk_matsim_network",
    _net_sql(
        _fixed(_XML, "<network>", "  <nodes>", "  </nodes>", '  <links capperiod="01:00:00">', "  </links>", "</network>") + "UNION ALL SELECT '    <node id=\"' || node || '\" x=\"' || x || '\" y=\"' || y || '\"/>' FROM nd UNION ALL "
        "SELECT printf('    <link id=\"%s\" from=\"%s\" to=\"%s\" length=\"%.2f\" freespeed=\"%.2f\" capacity=\"%d\" permlanes=\"%d\" modes=\"car\"/>', link_id, from_node, to_node, greatest(1.0, length), speed, greatest(1, lanes) * 1800, greatest(1, lanes)) FROM lk WHERE from_node <> to_node"
    ),
)
def snk_matsim_network(spark, sf_dir):
    return out.matsim_network(_nodes(spark, sf_dir), _links(spark, sf_dir))


#: Trips with a route of links: an order's lines in turn; every seventh has none.
_ROUTED = "rt AS (SELECT 't' || o AS trip_id, o % 86400 AS depart, CASE WHEN o % 7 = 0 THEN [] ELSE list_transform(ps, lambda p: 'l' || p) END AS links, 'l' || ps[1] AS origin_link, CASE WHEN o % 3 = 0 THEN 'l' || ps[-1] ELSE 'l0' END AS dest_link FROM (SELECT l_orderkey AS o, list(p ORDER BY l) AS ps FROM (SELECT l_orderkey, l_linenumber AS l, min(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY 1))"


def _routed(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    by = rows.groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p"))), lambda x: F.concat(F.lit("l"), x["p"])).alias("all"))
    return by.select(
        F.concat(F.lit("t"), "o").alias("trip_id"), (F.col("o") % 86_400).alias("depart"), F.when(F.col("o") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("all")).alias("links"),
        F.element_at("all", 1).alias("origin_link"), F.when(F.col("o") % 3 == 0, F.element_at("all", -1)).otherwise("l0").alias("dest_link"), F.lit("car").alias("mode"),
    )


@_document(
    "snk_sumo_routes",
    f"WITH {_ROUTED} " + _fixed(_XML, "<routes>", "</routes>", '  <vType id="std" vClass="passenger" length="5.0" minGap="2.5" width="1.8" maxSpeed="55.55" accel="2.6" decel="4.5" sigma="0.5"/>')
    + "UNION ALL SELECT unnest(['  <vehicle id=\"veh_' || trip_id || '\" type=\"std\" depart=\"' || depart || '\">', '    <route id=\"r_' || trip_id || '\" edges=\"' || array_to_string(links, ' ') || '\"/>', '  </vehicle>']) FROM rt WHERE len(links) > 0",
)
def snk_sumo_routes(spark, sf_dir):
    return out.sumo_routes(_routed(spark, sf_dir), "std")


@_document(
    "snk_matsim_plans",
    f"WITH {_ROUTED}, w AS (SELECT *, CASE WHEN len(links) > 0 AND links[1] = origin_link THEN links ELSE list_prepend(origin_link, links) END AS a FROM rt), v AS (SELECT *, CASE WHEN a[-1] = dest_link THEN a ELSE list_append(a, dest_link) END AS way FROM w) "
    + _fixed(_XML, "<population>", "</population>")
    + "UNION ALL SELECT unnest(['<person id=\"person_' || trip_id || '\">', '  <plan selected=\"yes\">', '    <activity type=\"h\" link=\"' || origin_link || '\" end_time=\"' || printf('%02d:%02d:%02d', depart // 3600, depart % 3600 // 60, depart % 60) || '\"/>', "
    "'    <leg mode=\"car\">', '      <route type=\"links\" start_link=\"' || way[1] || '\" end_link=\"' || way[-1] || '\">' || array_to_string(way, ' ') || '</route>', '    </leg>', '    <activity type=\"w\" link=\"' || dest_link || '\"/>', '  </plan>', '</person>']) FROM v",
)
def snk_matsim_plans(spark, sf_dir):
    return out.matsim_plans(_routed(spark, sf_dir))


#: Vehicle types: the parts' brands.
_TYPES = "vt AS (SELECT lower(replace(p_brand, '#', '_')) AS type, 4 + min(p_size) / 10.0::DOUBLE AS length FROM part GROUP BY 1)"


def _types(spark, sf_dir):
    return views.table(spark, sf_dir, "part").groupBy(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("type")).agg((F.min("p_size") / 10.0 + 4).alias("length"))


for _name in ("snk_matsim_vehicles", "snk_matsim_vtype"):

    @_document(
        _name,
        f"WITH {_TYPES} " + _fixed(_XML, '<vehicleDefinitions xmlns="http://www.matsim.org/files/dtd">', "</vehicleDefinitions>")
        + "UNION ALL SELECT unnest(['    <vehicleType id=\"' || type || '\">', '        <length meter=\"' || printf('%.1f', length + 2.5) || '\"/>', '        <width meter=\"1.8\"/>', '        <maximumVelocity meterPerSecond=\"55.55\"/>', "
        "'        <passengerCarEquivalents pce=\"1.0\"/>', '        <networkMode networkMode=\"car\"/>', '    </vehicleType>']) FROM vt",
    )
    def _vehicles(spark, sf_dir):
        return out.matsim_vehicle_types(_types(spark, sf_dir))


@_document("snk_sumo_vtype", f"WITH {_TYPES} SELECT '  <vType id=\"' || type || '\" vClass=\"passenger\" length=\"' || length || '\" minGap=\"2.5\" width=\"1.8\" maxSpeed=\"55.55\" accel=\"2.6\" decel=\"4.5\" sigma=\"0.5\"/>' AS line FROM vt")
def snk_sumo_vtype(spark, sf_dir):
    return out.sumo_vtypes(_types(spark, sf_dir))


@_document(
    "snk_matsim_config",
    views.with_views("runs", ", rn AS (SELECT DISTINCT scenario, seed FROM runs) SELECT unnest(['" + _XML + "', '<config>', '  <module name=\"global\"><param name=\"randomSeed\" value=\"' || seed || '\"/></module>', '  <module name=\"network\"><param name=\"inputFile\" value=\"' || scenario || '/network.xml\"/></module>', '  <module name=\"plans\"><param name=\"inputFile\" value=\"' || scenario || '/plans.xml\"/></module>', '</config>']) AS line FROM rn").replace(" , rn AS", ", rn AS"),
)
def snk_matsim_config(spark, sf_dir):
    runs = views.runs(spark, sf_dir).select("scenario", "seed").distinct()
    return out.matsim_config(runs.select(F.concat_ws("-", "scenario", "seed").alias("run"), "seed", *(F.concat("scenario", F.lit(f"/{k}.xml")).alias(k) for k in ("network", "plans"))))


#: A scenario for each mode of the trips: their horizon, and a seed by their number.
_SCENARIOS = ", sc AS (SELECT 'city_' || mode AS scenario_id, count(*) || ' trips & more' AS description, min(departure_time_s) AS start, max(departure_time_s) + 1 AS stop, count(*) % 1000 AS seed FROM trips GROUP BY mode) "


def _config(spark, sf_dir):
    n = F.count("*")
    by = views.trips(spark, sf_dir).groupBy(F.concat(F.lit("city_"), "mode").alias("scenario_id"))
    return out.config_xml(by.agg(F.concat(n.cast("string"), F.lit(" trips & more")).alias("description"), F.min("departure_time_s").alias("start"), (F.max("departure_time_s") + 1).alias("end"), (n % 1000).alias("seed")))


@_document(
    "snk_config_xml",
    views.with_views(
        "trips",
        _SCENARIOS + "SELECT unnest(['" + _XML + "', '<config>', '  <metadata scenario_id=\"' || scenario_id || '\">', '    <description>' || replace(description, '&', '&amp;') || '</description>', '  </metadata>', '  <time start_time_s=\"' || start || '\" end_time_s=\"' || stop || '\" time_step_s=\"1\"/>', "
        "'  <random seed=\"' || seed || '\" engine_seed_mode=\"fixed\"/>', '  <units length=\"meters\" speed=\"m/s\" time=\"seconds\"/>', '  <simulation warmup_time_s=\"0\" aggregation_interval_s=\"300\"/>', '</config>']) AS line FROM sc",
    ).replace(" , sc AS", ", sc AS"),
)
def snk_config_xml(spark, sf_dir):
    return _config(spark, sf_dir)


@query("src_config_meta", views.with_views("trips", _SCENARIOS + "SELECT CAST(start AS VARCHAR) AS start_time_s, CAST(stop AS VARCHAR) AS end_time_s, '1' AS time_step_s FROM sc").replace(" , sc AS", ", sc AS"))
def src_config_meta(spark, sf_dir):
    path = _path(spark, "config")
    doc.write(_config(spark, sf_dir), path)
    return src.xml_rows(spark, path, "time", ["start_time_s", "end_time_s", "time_step_s"]).drop("pos")


#: Demand periods of the trips by their purpose.
_PERIODS = ", pd AS (SELECT CASE WHEN purpose LIKE '%\\_AM%' ESCAPE '\\' THEN 'AM' ELSE 'PM' END AS period, min(departure_time_s) // 3600 AS a, max(departure_time_s) // 3600 + 1 AS b FROM trips GROUP BY 1), pr AS (SELECT CASE period WHEN 'AM' THEN 1 ELSE 2 END AS id, period, printf('%02d00', a) AS first, printf('%02d00', b) AS last FROM pd), it AS (SELECT 10 * count(DISTINCT mode) AS n FROM trips) "


def _periods(spark, sf_dir):
    period = F.when(F.col("purpose").contains("_AM"), "AM").otherwise("PM")
    hour = lambda x: F.format_string("%02d00", F.floor(x / 3600))
    by = views.trips(spark, sf_dir).groupBy(period.alias("period")).agg(F.min("departure_time_s").alias("a"), F.max("departure_time_s").alias("b"))
    return by.select(F.when(F.col("period") == "AM", 1).otherwise(2).alias("period_id"), "period", hour(F.col("a")).alias("first"), hour(F.col("b") + 3600).alias("last"))


def _agents_of(spark, sf_dir):
    return views.trips(spark, sf_dir).select(F.col("mode").alias("agent")).distinct()


@_document("snk_gmns_settings_csv", views.with_views("trips", _PERIODS + _fixed("[assignment]", "assignment_mode,number_of_iterations,column_updating_iterations", "[demand_period]", "demand_period_id,demand_period,time_period") + "UNION ALL SELECT 'ue,' || n || ',' || n FROM it UNION ALL SELECT id || ',' || period || ',' || first || '_' || last FROM pr").replace(" , pd AS", ", pd AS"))
def snk_gmns_settings_csv(spark, sf_dir):
    return out.gmns_settings(_periods(spark, sf_dir), 10 * _agents_of(spark, sf_dir).count())


@_document("snk_gmns_settings_yml", views.with_views("trips", _PERIODS + _fixed("---", "agents:", "demand_periods:", "assignment:") + "UNION ALL SELECT '  iterations: ' || n FROM it UNION ALL SELECT unnest(['  - type: ' || substr(mode, 1, 1), '    name: ' || mode, '    vot: 10']) FROM (SELECT DISTINCT mode FROM trips) UNION ALL SELECT unnest(['  - period: ' || period, '    time_period: ' || first || '-' || last]) FROM pr").replace(" , pd AS", ", pd AS"))
def snk_gmns_settings_yml(spark, sf_dir):
    return out.gmns_settings_yml(_agents_of(spark, sf_dir), _periods(spark, sf_dir), 10 * _agents_of(spark, sf_dir).count())


@_document(
    "snk_signals_xml",
    views.with_views(
        "links",
        ", o AS (SELECT to_node AS node, link_pos, link_id, row_number() OVER (PARTITION BY to_node ORDER BY link_pos) % 2 AS t FROM links), g AS (SELECT node, coalesce(list(link_id ORDER BY link_pos) FILTER (t = 1), []) AS a, coalesce(list(link_id ORDER BY link_pos) FILTER (t = 0), []) AS b FROM o GROUP BY node), "
        "p AS (SELECT node, unnest(['p1', 'p1y', 'ar1', 'p2', 'p2y', 'ar2']) AS id, unnest([40, 3, 2, 40, 3, 2]) AS s, unnest(['G', 'y', 'r', 'G', 'y', 'r']) AS c, unnest([a, a, [], b, b, []]) AS l FROM g) "
        + _fixed(_XML, "<signals>", "</signals>")
        + "UNION ALL SELECT unnest(['  <junction id=\"tl_' || node || '\" node_id=\"' || node || '\" cycle_length_s=\"90\">', '  </junction>']) FROM g "
        "UNION ALL SELECT unnest(list_concat(['    <phase id=\"' || id || '\" duration_s=\"' || s || '\" state=\"' || c || '\">'], list_transform(l, lambda x: '      <link_ref id=\"' || x || '\"/>'), ['    </phase>'])) FROM p",
    ),
)
def snk_signals_xml(spark, sf_dir):
    links = views.links(spark, sf_dir)
    return out.signals_xml(signals.controllers(links.select(F.col("to_node").alias("node")).distinct(), links))


@query("val_signals", views.with_views("links", "SELECT 'tl_' || to_node AS id, to_node AS node_id FROM links GROUP BY to_node"))
def val_signals(spark, sf_dir):
    path, links = _path(spark, "signals"), views.links(spark, sf_dir)
    doc.write(out.signals_xml(signals.controllers(links.select(F.col("to_node").alias("node")).distinct(), links)), path)
    return src.xml(spark, path, "junction", "_id string, _node_id string").select(F.col("_id").alias("id"), F.col("_node_id").alias("node_id"))


#: Readers of networks.
@query("src_network_scc", _net_sql("SELECT from_node, to_node FROM lk WHERE from_node <> to_node"))
def src_network_scc(spark, sf_dir):
    return src.scc_edges(spark, _network(spark, sf_dir))


@query("src_network_routing", _net_sql("SELECT link_id, row_number() OVER (ORDER BY link_id) - 1 AS link_pos, from_node, to_node FROM lk"))
def src_network_routing(spark, sf_dir):
    return src.routing_links(spark, _network(spark, sf_dir))


@query("src_network_sumo", _net_sql("SELECT link_id, from_node, to_node, greatest(0.1, round_even(length, 2)) AS length, greatest(0.1, speed) AS speed, greatest(1, lanes) AS lanes FROM lk"))
def src_network_sumo(spark, sf_dir):
    return src.sumo_links(spark, _network(spark, sf_dir))


@query("src_network_matsim", _net_sql("SELECT link_id, from_node, to_node, round_even(length, 2) AS length, speed, lanes FROM lk"))
def src_network_matsim(spark, sf_dir):
    return src.matsim_links(spark, _network(spark, sf_dir))


@query("src_network_topology", _net_sql("SELECT node, has_signal, coalesce((SELECT string_agg(link_id, ' ' ORDER BY link_id) FROM lk WHERE to_node = node), '') AS into, coalesce((SELECT string_agg(link_id, ' ' ORDER BY link_id) FROM lk WHERE from_node = node), '') AS out FROM nd").replace(" AS into,", ' AS "into",'))
def src_network_topology(spark, sf_dir):
    return src.topology(spark, _network(spark, sf_dir)).select("node", "has_signal", F.array_join("into", " ").alias("into"), F.array_join("out", " ").alias("out"))


for _name in ("src_network_demandgen", "src_network_synth"):

    @query(_name, _net_sql("SELECT node, x, y, (SELECT count(*) FROM lk WHERE from_node = node AND to_node <> node) + (SELECT count(*) FROM lk WHERE to_node = node AND from_node <> node) AS degree FROM nd"))
    def _degrees(spark, sf_dir):
        return src.nodes_with_degree(spark, _network(spark, sf_dir))


@query("src_network_viz", _net_sql("SELECT link_id, from_node, to_node, road, coalesce(CASE osm_way_id WHEN '77' THEN '77' WHEN '[1, 2]' THEN '1 2' END, '') AS ways FROM lk"))
def src_network_viz(spark, sf_dir):
    return src.drawn_links(spark, _network(spark, sf_dir)).withColumn("ways", F.array_join(F.col("ways").cast("array<string>"), " "))


@query("src_turn_restrictions", _net_sql("SELECT type, from_link, via_node, to_link FROM tr"))
def src_turn_restrictions(spark, sf_dir):
    return src.turn_restrictions(spark, _network(spark, sf_dir))


@query("agg_count_xml", _net_sql("SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM lk) AS links"))
def agg_count_xml(spark, sf_dir):
    path = _network(spark, sf_dir)
    count = lambda tag: src.xml_rows(spark, path, tag, ["id"]).agg(F.count("*").alias(f"{tag}s"))
    return count("node").crossJoin(count("link"))  # one row each


#: The last quarter of the nodes repeats ids of the first; every fortieth has none.
@query("val_nodes", "SELECT 'n' || (id % m) AS node, CASE WHEN id % 40 = 0 THEN 'empty_id' ELSE 'duplicate_id' END AS rule FROM (SELECT c_custkey AS id FROM customer), (SELECT count(*) * 3 // 4 AS m FROM customer) WHERE id % 40 = 0 OR (id >= m AND (id - m) % 40 <> 0)")
def val_nodes(spark, sf_dir):
    rows = _nodes(spark, sf_dir).withColumn("k", F.substring("node", 2, 9).cast("long"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.expr("count(*) * 3 div 4").alias("m"))))  # one row
    path = _path(spark, "nodes")
    named = rows.withColumn("node", F.concat(F.lit("n"), F.col("k") % F.col("m"))).withColumn("id", F.when(F.col("k") % 40 == 0, "").otherwise(F.col("node")))
    line = doc.element("node", {"id": F.col("id"), "name": F.col("node")})
    doc.write(doc.document(doc.section(0, named, F.lpad(F.col("k").cast("string"), 9, "0"), line)), path)
    read = src.xml_rows(spark, path, "node", ["id", "name"])
    often = read.where(src.filled("id")).groupBy("id").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = read.join(often, "id").where("pos > first").select(F.col("name").alias("node"), F.lit("duplicate_id").alias("rule"))
    return read.where(~src.filled("id")).select(F.col("name").alias("node"), F.lit("empty_id").alias("rule")).union(again)


#: Demand files.
_DEMAND = ["trip_id", "origin AS origin_node_id", "destination AS destination_node_id", "CAST(departure_time_s AS STRING) AS departure_time_s", "mode", "CASE WHEN purpose LIKE '%chained' THEN 'schedule' ELSE 'gravity' END AS dest_source", "purpose"]


def _demand_file(spark, sf_dir, columns):
    path = _path(spark, "demand")
    views.trips(spark, sf_dir).selectExpr(*_DEMAND).select(*columns).write.option("header", True).csv(path)
    return path


_FIVE = ["trip_id", "origin_node_id", "destination_node_id", "departure_time_s", "mode"]


def _demand_sql(columns, where=""):
    return views.with_views("trips", f", d AS (SELECT {', '.join(_DEMAND)} FROM trips) SELECT {', '.join(columns)} FROM d {where}")


@query("snk_demand_csv", _demand_sql(_FIVE))
def snk_demand_csv(spark, sf_dir):
    return src.csv(spark, _demand_file(spark, sf_dir, _FIVE), _FIVE)


@query("snk_demand_csv_census", _demand_sql([*_FIVE, "dest_source", "purpose"]))
def snk_demand_csv_census(spark, sf_dir):
    columns = [*_FIVE, "dest_source", "purpose"]
    return src.csv(spark, _demand_file(spark, sf_dir, columns), columns)


@query("src_demand_viz", _demand_sql([*_FIVE, "CAST(NULL AS VARCHAR) AS dest_source", "CAST(NULL AS VARCHAR) AS purpose"], "WHERE destination_node_id IS NOT NULL"))
def src_demand_viz(spark, sf_dir):
    return src.demand(spark, _demand_file(spark, sf_dir, _FIVE))


@query("agg_count_csv", views.with_views("trips", "SELECT count(*) AS rows FROM trips"))
def agg_count_csv(spark, sf_dir):
    return src.csv(spark, _demand_file(spark, sf_dir, _FIVE), _FIVE).agg(F.count("*").alias("rows"))


#: Headers of the bundles' demand files: two columns are there where an order of the bundle asks for them.
_HEADERS = "hd AS (SELECT o_custkey % 50 AS bundle, bool_or(o_orderkey % 97 = 0) AS a, bool_or(o_orderkey % 89 = 0) AS b FROM orders GROUP BY 1)"


@query("set_missing_columns", f"WITH {_HEADERS} SELECT bundle, 'dest_source' AS missing FROM hd WHERE NOT a UNION ALL SELECT bundle, 'purpose' FROM hd WHERE NOT b")
def set_missing_columns(spark, sf_dir):
    path = _path(spark, "headers")
    by = views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("bundle")).agg(F.bool_or(F.col("o_orderkey") % 97 == 0).alias("a"), F.bool_or(F.col("o_orderkey") % 89 == 0).alias("b"))
    line = F.concat(F.lit(",".join(_FIVE)), F.when(F.col("a"), ",dest_source").otherwise(""), F.when(F.col("b"), ",purpose").otherwise(""))
    by.select("bundle", line.alias("line")).write.partitionBy("bundle").text(path)
    return src.missing_columns(spark.read.schema("value string, bundle long").text(path), "bundle", [*_FIVE, "dest_source", "purpose"])


#: Tables for the assignment engine.
@query("snk_gmns_node", _net_sql("SELECT CAST(substr(node, 2) AS BIGINT) AS node_id, CASE WHEN CAST(substr(node, 2) AS BIGINT) % 3 = 0 THEN substr(node, 2) END AS zone_id, printf('%.6f', x) AS x_coord, printf('%.6f', y) AS y_coord FROM nd").replace("SELECT CAST(substr(node, 2) AS BIGINT) AS node_id", "SELECT substr(node, 2) AS node_id"))
def snk_gmns_node(spark, sf_dir):
    nodes, path = _nodes(spark, sf_dir), _path(spark, "node.csv")
    out.gmns_nodes(nodes, nodes.where("CAST(substr(node, 2) AS BIGINT) % 3 = 0")).write.option("header", True).csv(path)
    return src.csv(spark, path, ["node_id", "zone_id", "x_coord", "y_coord"])


@query("snk_gmns_link", _net_sql("SELECT substr(link_id, 2) AS link_id, substr(from_node, 2) AS from_node_id, substr(to_node, 2) AS to_node_id, printf('%.5f', greatest(length / 1000, 0.001)) AS length, CAST(greatest(lanes, 1) AS VARCHAR) AS lanes, CAST(greatest(lanes, 1) * 1800 AS VARCHAR) AS capacity, printf('%.1f', greatest(speed * 3.6::DOUBLE, 5)) AS free_speed, '4' AS \"VDF_beta1\" FROM lk WHERE from_node <> to_node AND length >= 1"))
def snk_gmns_link(spark, sf_dir):
    path = _path(spark, "link.csv")
    out.gmns_links(_links(spark, sf_dir)).write.option("header", True).csv(path)
    return src.csv(spark, path, ["link_id", "from_node_id", "to_node_id", "length", "lanes", "capacity", "free_speed", "VDF_beta1"])


@query("snk_gmns_movement", _net_sql("SELECT 'm' || (row_number() OVER (ORDER BY via_node, from_link, to_link) - 1) AS mvmt_id, via_node AS node_id, from_link AS ib_link_id, to_link AS ob_link_id, CASE type WHEN 'no_left_turn' THEN 'left' WHEN 'only_straight_on' THEN 'thru' ELSE 'other' END AS type, '99999' AS penalty FROM tr"))
def snk_gmns_movement(spark, sf_dir):
    path = _path(spark, "movement.csv")
    placed = ranges.numbered(_rules(spark, sf_dir), ["via_node", "from_link", "to_link"], F.substring("via_node", 1, 3), "k")
    out.gmns_movements(placed).write.option("header", True).csv(path)
    return src.csv(spark, path, ["mvmt_id", "node_id", "ib_link_id", "ob_link_id", "type", "penalty"])


@query("snk_gmns_demand", views.with_views("trips", "SELECT substr(origin, 2) AS o_zone_id, substr(destination, 2) AS d_zone_id, CAST(count(*) AS VARCHAR) AS volume FROM trips WHERE origin <> destination GROUP BY ALL"))
def snk_gmns_demand(spark, sf_dir):
    path = _path(spark, "demand.csv")
    out.gmns_demand(views.trips(spark, sf_dir)).write.option("header", True).csv(path)
    return src.csv(spark, path, ["o_zone_id", "d_zone_id", "volume"])


#: Manifests and bundles.
#: Files of bundles: an order's priority stands for what a file holds.
_BUNDLE = "b AS (SELECT o_custkey % 50 AS bundle, CASE o_orderkey % 5 WHEN 0 THEN 'network.xml' WHEN 1 THEN 'demand.csv' WHEN 2 THEN 'config.xml' WHEN 3 THEN 'signals.xml' ELSE 'notes.txt' END AS name, min(o_orderpriority) AS content FROM orders GROUP BY ALL)"


def _bundle_files(spark, sf_dir):
    name = "CASE o_orderkey % 5 WHEN 0 THEN 'network.xml' WHEN 1 THEN 'demand.csv' WHEN 2 THEN 'config.xml' WHEN 3 THEN 'signals.xml' ELSE 'notes.txt' END"
    return views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("bundle"), F.expr(name).alias("name")).agg(F.min("o_orderpriority").alias("content"))


_MANIFEST = f"{_BUNDLE}, mf AS (SELECT 'b' || bundle AS scenario, replace(replace(name, '.xml', ''), '.csv', '') AS type, 'b' || bundle || '/' || name AS path, CASE WHEN bundle % 7 <> 0 THEN sha256(content) END AS sha256, bundle FROM b WHERE name <> 'notes.txt')"


def _manifest_rows(spark, sf_dir):
    rows = _bundle_files(spark, sf_dir).where("name <> 'notes.txt'")
    scenario = F.concat(F.lit("b"), "bundle")
    return rows.select(scenario.alias("scenario"), F.regexp_replace("name", r"\.(xml|csv)$", "").alias("type"), F.concat_ws("/", scenario, "name").alias("path"), F.when(F.col("bundle") % 7 != 0, F.sha2("content", 256)).alias("sha256"))


def _manifest(spark, rows):
    path = _path(spark, "manifest")
    doc.write(out.manifest_xml(rows), path)
    return path


@_document("snk_manifest_xml", f"WITH {_MANIFEST} SELECT unnest(['{_XML}', '<manifest version=\"0.2\">', '  <scenario id=\"' || scenario || '\"/>', '  <canonical_files>', '  </canonical_files>', '</manifest>']) AS line FROM (SELECT DISTINCT scenario FROM mf) UNION ALL SELECT '    <file type=\"' || type || '\" path=\"' || path || '\"' || coalesce(' sha256=\"' || sha256 || '\"', '') || '/>' FROM mf")
def snk_manifest_xml(spark, sf_dir):
    return out.manifest_xml(_manifest_rows(spark, sf_dir))


for _name, _required in (("src_manifest", ("network", "demand")), ("src_manifest_sumo", ("network", "demand", "config")), ("src_manifest_matsim", ())):

    def _read_manifest(spark, sf_dir, required=_required):
        return src.manifest(spark, _manifest(spark, _manifest_rows(spark, sf_dir)), required)

    query(_name, f"WITH {_MANIFEST} SELECT type, path, sha256 FROM mf")(_read_manifest)


@query("val_manifest", f"WITH {_MANIFEST}, mm AS (SELECT scenario, type FROM mf UNION ALL SELECT scenario, type FROM mf WHERE type = 'network' AND sha256 IS NULL), wn AS (SELECT scenario, unnest(['network', 'demand', 'config', 'signals']) AS type FROM (SELECT DISTINCT scenario FROM mf)) SELECT scenario, type, count(mm.type) AS n FROM wn LEFT JOIN mm USING (scenario, type) GROUP BY ALL HAVING count(mm.type) <> 1")
def val_manifest(spark, sf_dir):
    rows = _manifest_rows(spark, sf_dir)
    rows = rows.union(rows.where("type = 'network' AND sha256 IS NULL"))  # some name their network twice
    read = src.manifest(spark, _manifest(spark, rows)).withColumn("scenario", F.split("path", "/")[0])
    wanted = read.select("scenario").distinct().withColumn("type", F.explode(F.array(*map(F.lit, ("network", "demand", "config", "signals")))))
    return wanted.join(read.groupBy("scenario", "type").agg(F.count("*").alias("k")), ["scenario", "type"], "left").select("scenario", "type", F.coalesce("k", F.lit(0)).alias("n")).where("n <> 1")


@query("src_provenance", f"WITH {_BUNDLE} SELECT bundle, name, sha256(content) AS sha256 FROM b")
def src_provenance(spark, sf_dir):
    path = _path(spark, "bundles")
    _bundle_files(spark, sf_dir).write.partitionBy("bundle", "name").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    part = lambda k: F.regexp_extract("path", rf"{k}=([^/]+)/", 1)
    content = F.regexp_replace(F.col("content").cast("string"), "\n$", "")
    return files.select(part("bundle").cast("long").alias("bundle"), part("name").alias("name"), F.sha2(content, 256).alias("sha256"))


@query("src_bundle_paths", f"WITH {_BUNDLE} SELECT bundle, name FROM b WHERE name <> 'notes.txt' AND bundle % 7 <> 0")
def src_bundle_paths(spark, sf_dir):
    path = _path(spark, "bundles")
    _bundle_files(spark, sf_dir).where("bundle % 7 <> 0").write.partitionBy("bundle", "name").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path")
    part = lambda k: F.regexp_extract("path", rf"{k}=([^/]+)/", 1)
    return files.select(part("bundle").cast("long").alias("bundle"), part("name").alias("name")).where("name IN ('network.xml', 'demand.csv', 'config.xml', 'signals.xml')")


@query("src_discover_bundle", f"WITH {_BUNDLE} SELECT bundle, bool_or(name = 'network.xml') AND bool_or(name = 'demand.csv') AS has_bundle, count(*) FILTER (name <> 'notes.txt') AS files FROM b GROUP BY bundle")
def src_discover_bundle(spark, sf_dir):
    has = lambda n: F.bool_or(F.col("name") == n)
    return _bundle_files(spark, sf_dir).groupBy("bundle").agg((has("network.xml") & has("demand.csv")).alias("has_bundle"), F.count(F.when(F.col("name") != "notes.txt", 1)).alias("files"))


@query("prj_map_available", f"WITH {_BUNDLE}, k AS (SELECT bundle, count(*) AS n FROM b GROUP BY bundle) SELECT bundle, map, CASE map WHEN 'od_origins' THEN n >= 5 WHEN 'link_load' THEN bundle % 3 >= 1 WHEN 'route_diversity' THEN bundle % 3 >= 2 WHEN 'animated_flow' THEN bundle % 4 = 0 ELSE false END AS available FROM k, (SELECT unnest(['od_origins', 'link_load', 'route_diversity', 'animated_flow', 'odd']) AS map)")
def prj_map_available(spark, sf_dir):
    flags = _bundle_files(spark, sf_dir).groupBy("bundle").agg((F.count("*") >= 5).alias("has_bundle")).select("bundle", "has_bundle", (F.col("bundle") % 3).alias("engines"), (F.col("bundle") % 4 == 0).alias("events"))
    kinds = {"od_origins": F.col("has_bundle"), "link_load": F.col("engines") >= 1, "route_diversity": F.col("engines") >= 2, "animated_flow": F.col("events"), "odd": F.lit(False)}
    return flags.select("bundle", F.explode(F.array(*(F.struct(F.lit(k).alias("map"), v.alias("available")) for k, v in kinds.items()))).alias("m")).select("bundle", "m.map", "m.available")


@query("val_hash", f"WITH {_BUNDLE} SELECT bundle, name FROM b WHERE name <> 'config.xml' AND bundle % 10 = 0")
def val_hash(spark, sf_dir):
    files = _bundle_files(spark, sf_dir)
    # what the manifest says: no hash of one file, a wrong one in some bundles
    said = files.select("bundle", "name", F.when(F.col("name") != "config.xml", F.sha2(F.concat("content", F.when(F.col("bundle") % 10 == 0, "x").otherwise("")), 256)).alias("said"))
    return said.join(files, ["bundle", "name"]).where("said IS NOT NULL AND said <> sha2(content, 256)").select("bundle", "name")


@query("join_manifest_files", f"WITH {_BUNDLE} SELECT bundle, name, CASE WHEN bundle % 6 = 0 THEN 'absent' WHEN bundle % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM b")
def join_manifest_files(spark, sf_dir):
    files = _bundle_files(spark, sf_dir)
    said = files.select("bundle", "name", F.sha2(F.concat("content", F.when(F.col("bundle") % 10 == 0, "x").otherwise("")), 256).alias("said"))
    there = files.where("bundle % 6 <> 0").select("bundle", "name", F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "absent").when(F.col("found") != F.col("said"), "mismatch").otherwise("ok")
    return said.join(there, ["bundle", "name"], "left").select("bundle", "name", state.alias("state"))


@query("val_config", f"WITH {_BUNDLE} SELECT bundle, CASE WHEN bundle % 9 = 0 THEN 'id' ELSE 'units' END AS rule FROM b WHERE name = 'config.xml' AND (bundle % 9 = 0 OR content LIKE '1%')")
def val_config(spark, sf_dir):
    config = _bundle_files(spark, sf_dir).where("name = 'config.xml'").select("bundle", (F.col("bundle") + F.when(F.col("bundle") % 9 == 0, 1).otherwise(0)).alias("own_id"), F.when(~F.col("content").startswith("1"), "meters").alias("units"))
    rule = F.when(F.col("own_id") != F.col("bundle"), "id").when(F.col("units").isNull(), "units")
    return config.select("bundle", rule.alias("rule")).where("rule IS NOT NULL")


@query("val_units", f"WITH {_BUNDLE} SELECT bundle FROM b GROUP BY bundle HAVING count(DISTINCT CASE WHEN bundle % 4 = 0 AND name = 'config.xml' THEN 'miles' ELSE 'meters' END) > 1")
def val_units(spark, sf_dir):
    return _bundle_files(spark, sf_dir).groupBy("bundle").agg(F.count_distinct(F.when((F.col("bundle") % 4 == 0) & (F.col("name") == "config.xml"), "miles").otherwise("meters")).alias("units")).where("units > 1").select("bundle")


#: Engine outputs.
_TIMES = "tt AS (SELECT l_orderkey AS o, min(l_partkey) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1)"


def _times(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"))


def _tripinfo(spark, sf_dir):
    path = _path(spark, "tripinfo")
    duration = F.when(F.col("p") % 9 == 0, "broken").when(F.col("p") % 9 == 1, "0.0").otherwise(F.concat(F.col("p").cast("string"), F.lit(".5")))
    rows = _times(spark, sf_dir)
    line = doc.element("tripinfo", {"id": F.concat(F.lit("veh_t"), "o"), "depart": F.col("o") % 3600, "duration": duration, "routeLength": F.col("p") * 10})
    doc.write(doc.document(doc.section(0, rows, F.col("o"), line)), path)
    return path


_TRIPS = f"WITH {_TIMES}, ti AS (SELECT 't' || o AS trip_id, CAST(o % 3600 AS DOUBLE) AS depart, CASE WHEN p % 9 = 1 THEN 0.0 ELSE p + 0.5 END::DOUBLE AS duration, CAST(p * 10 AS DOUBLE) AS length FROM tt WHERE p % 9 <> 0) "


@query("src_sumo_trips", _TRIPS + "SELECT * FROM ti")
def src_sumo_trips(spark, sf_dir):
    return src.tripinfo(spark, _tripinfo(spark, sf_dir)).drop("pos")


@query("src_sumo_tt_by_trip", _TRIPS + "SELECT trip_id, duration FROM ti")
def src_sumo_tt_by_trip(spark, sf_dir):
    return src.last_by_trip(src.tripinfo(spark, _tripinfo(spark, sf_dir)), "duration")


@query("src_sumo_tt_audit", _TRIPS + "SELECT duration FROM ti WHERE duration > 0")
def src_sumo_tt_audit(spark, sf_dir):
    return src.tripinfo(spark, _tripinfo(spark, sf_dir)).where("duration > 0").select("duration")


for _name in ("src_sumo_tripinfo", "agg_sumo_cli_summary"):

    @query(_name, _TRIPS + "SELECT count(*) AS n, round(coalesce(avg(duration), 0), 4) AS mean, min(duration) AS least, max(duration) AS greatest, list_sort(list(duration))[1 + CAST(floor((count(*) - 1) * 95 / 100) AS BIGINT)] AS p95 FROM ti")
    def _summary(spark, sf_dir):
        return statistics.rounded(reports.trip_stats(src.tripinfo(spark, _tripinfo(spark, sf_dir)), [], "duration"))


@query("src_sumo_routes", f"WITH {_ROUTED} SELECT trip_id, array_to_string(links, ' ') AS links FROM rt WHERE len(links) > 0")
def src_sumo_routes(spark, sf_dir):
    path = _path(spark, "routes")
    doc.write(out.sumo_routes(_routed(spark, sf_dir), "std"), path)
    return src.sumo_routes(spark, path).withColumn("links", F.array_join("links", " "))


_COUNTS = f"WITH {_ROUTED}, u AS (SELECT trip_id, unnest(links) AS link FROM rt) SELECT link, count(*) AS n FROM u "


@query("agg_link_volume_sumo", _COUNTS + "GROUP BY link")
def agg_link_volume_sumo(spark, sf_dir):
    path = _path(spark, "routes")
    doc.write(out.sumo_routes(_routed(spark, sf_dir), "std"), path)
    return src.sumo_routes(spark, path).select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


for _name in ("agg_link_counts", "flt_completed"):

    @query(_name, _COUNTS + "WHERE CAST(substr(trip_id, 2) AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY link")
    def _completed(spark, sf_dir):
        done = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("t"), "o_orderkey").alias("trip_id"))
        return _routed(spark, sf_dir).join(done, "trip_id", "left_semi").select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


@query("agg_link_volume_matsim", f"WITH {_ROUTED}, w AS (SELECT *, CASE WHEN len(links) > 0 AND links[1] = origin_link THEN links ELSE list_prepend(origin_link, links) END AS a FROM rt), v AS (SELECT unnest(CASE WHEN a[-1] = dest_link THEN a ELSE list_append(a, dest_link) END) AS link FROM w) SELECT link, count(*) AS n FROM v GROUP BY link")
def agg_link_volume_matsim(spark, sf_dir):
    path = _path(spark, "plans")
    doc.write(out.matsim_plans(_routed(spark, sf_dir)), path)
    rows = src.xml(spark, path, "route", "_type string, _VALUE string").where("_type = 'links'")
    return rows.select(F.explode(F.split(F.trim("_VALUE"), r"\s+")).alias("link")).groupBy("link").agg(F.count("*").alias("n"))


@query("agg_persons", f"WITH {_ROUTED} SELECT count(*) AS persons FROM rt")
def agg_persons(spark, sf_dir):
    path = _path(spark, "plans")
    doc.write(out.matsim_plans(_routed(spark, sf_dir)), path)
    return src.xml(spark, path, "person", "_id string").agg(F.count("*").alias("persons"))


def _matsim_table(spark, sf_dir):
    path = _path(spark, "output_trips")
    hms = F.format_string("%02d:%02d:%02d", F.floor(F.col("p") / 3600), F.floor(F.col("p") / 60) % 60, F.col("p") % 60)
    rows = _times(spark, sf_dir).select(F.concat(F.lit("person_t"), "o").alias("person"), F.when(F.col("p") % 9 == 0, "broken").otherwise(hms).alias("trav_time"), F.lit("07:00:00").alias("dep_time"), (F.col("q") * 100).cast("double").alias("traveled_distance"))
    rows.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    return path


_PERSONS = f"WITH {_TIMES}, ms AS (SELECT 't' || o AS trip_id, CASE WHEN p % 9 = 0 THEN 0 ELSE p END::DOUBLE AS seconds, 25200.0::DOUBLE AS depart, CAST(q * 100 AS DOUBLE) AS distance FROM tt) "


@query("src_matsim_trips", _PERSONS + "SELECT * FROM ms")
def src_matsim_trips(spark, sf_dir):
    return src.matsim_trips(spark, _matsim_table(spark, sf_dir))


@query("src_matsim_tt_by_trip", _PERSONS + "SELECT trip_id, seconds FROM ms")
def src_matsim_tt_by_trip(spark, sf_dir):
    return src.matsim_trips(spark, _matsim_table(spark, sf_dir)).select("trip_id", "seconds")


@query("src_matsim_trips_audit", _PERSONS + "SELECT seconds FROM ms WHERE seconds > 0")
def src_matsim_trips_audit(spark, sf_dir):
    return src.matsim_trips(spark, _matsim_table(spark, sf_dir)).where("seconds > 0").select("seconds")


@query("src_matsim_output", _PERSONS + "SELECT count(*) AS n, round(avg(seconds), 4) AS mean, min(seconds) AS least, max(seconds) AS greatest, median(seconds) AS q50, list_sort(list(seconds))[1 + CAST(least(floor(count(*) * 95 / 100), count(*) - 1) AS BIGINT)] AS p95 FROM ms WHERE seconds > 0")
def src_matsim_output(spark, sf_dir):
    rows = src.matsim_trips(spark, _matsim_table(spark, sf_dir)).where("seconds > 0")
    base = rows.agg(F.count("*").alias("n"), numbers.rounded(F.avg("seconds"), 4).alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("greatest"))
    p95 = statistics.floor_percentile(rows, [], "seconds", of_n=True).select(F.col("p").alias("p95"))
    return base.crossJoin(F.broadcast(p95)).crossJoin(F.broadcast(reports.quartiles(rows, [], "seconds", (0.5,)).drop("n")))  # one row each


def _agents(spark, sf_dir):
    path = _path(spark, "agent")
    p = F.col("p")
    rows = _times(spark, sf_dir).select(
        (F.col("o") % 40).alias("o_zone_id"), (p % 40).alias("d_zone_id"), F.when(p % 10 == 0, "").otherwise((F.col("q") / 4).cast("double").cast("string")).alias("volume"),
        F.when(p % 9 == 0, "bad").when(p % 9 == 1, "0").when(p % 9 == 2, "NaN").otherwise(p.cast("string")).alias("travel_time"), (p % 30).cast("string").alias("distance"),
    )
    rows.write.option("header", True).csv(path)
    return path


_AGENTS = (
    f"WITH {_TIMES}, ag AS (SELECT 'n' || (o % 40) AS origin, 'n' || (p % 40) AS destination, CASE WHEN p % 9 = 1 THEN 0 WHEN p % 9 = 2 THEN 'NaN'::DOUBLE ELSE p * 60 END::DOUBLE AS tt, (p % 30 * 1000)::DOUBLE AS distance, CASE WHEN p % 10 = 0 THEN 1 ELSE q / 4 END::DOUBLE AS volume FROM tt WHERE p % 9 <> 0), "
    "fi AS (SELECT *, CAST(round_even(volume, 0) AS BIGINT) AS w FROM ag WHERE NOT isnan(tt)), "
    "ru AS (SELECT tt, sum(w) OVER (ORDER BY tt) AS upto, sum(w) OVER () AS n FROM fi WHERE w > 0 AND tt > 0) "
)


@query("src_dtalite_output", _AGENTS + "SELECT CAST(sum(w) AS BIGINT) AS trip_count, CAST(sum(w) FILTER (tt > 0) AS BIGINT) AS completed, round(sum(w * tt) FILTER (tt > 0) / sum(w) FILTER (tt > 0), 4) AS mean_tt, round(sum(w * distance) FILTER (tt > 0) / sum(w) FILTER (tt > 0), 4) AS mean_distance, (SELECT min(tt) FROM ru WHERE upto > floor((n - 1) * 95 / 100)) AS p95_tt FROM fi WHERE w > 0")
def src_dtalite_output(spark, sf_dir):
    return statistics.rounded(statistics.weighted_trips(src.dtalite_agents(spark, _agents(spark, sf_dir)), []))


@query("src_dtalite_tt_xf", _AGENTS + "SELECT tt, CAST(sum(w) AS BIGINT) AS n FROM fi WHERE w > 0 AND tt > 0 GROUP BY tt")
def src_dtalite_tt_xf(spark, sf_dir):
    rows = src.dtalite_agents(spark, _agents(spark, sf_dir)).withColumn("w", F.bround("volume", 0).cast("long"))
    return rows.where("w > 0 AND tt > 0 AND NOT isnan(tt)").groupBy("tt").agg(F.sum("w").alias("n"))


@query("src_dtalite_tt_audit", _AGENTS + "SELECT tt, CAST(sum(greatest(1, w)) AS BIGINT) AS n FROM fi WHERE tt > 0 GROUP BY tt")
def src_dtalite_tt_audit(spark, sf_dir):
    rows = src.dtalite_agents(spark, _agents(spark, sf_dir)).where("tt > 0 AND NOT isnan(tt)")
    return rows.groupBy("tt").agg(F.sum(F.greatest(F.lit(1), F.bround("volume", 0).cast("long"))).alias("n"))


@query("src_dtalite_trips", _AGENTS + "SELECT origin, destination, tt, distance FROM ag WHERE NOT isnan(tt)")
def src_dtalite_trips(spark, sf_dir):
    return src.dtalite_trips(spark, _agents(spark, sf_dir)).where("NOT isnan(tt)")


@query("src_dtalite_links", f"WITH {_TIMES} SELECT CAST(p AS VARCHAR) AS link_id, CAST(q AS DOUBLE) AS volume, CAST(p % 50 AS DOUBLE) AS mean_kmh, CASE WHEN p % 3 = 0 THEN p % 50 ELSE 60 END::DOUBLE AS free_kmh, CAST(p % 7 * 60 AS DOUBLE) AS seconds FROM tt")
def src_dtalite_links(spark, sf_dir):
    path = _path(spark, "link_performance")
    p = F.col("p")
    rows = _times(spark, sf_dir).select(p.alias("link_id"), F.col("q").alias("volume"), (p % 50).alias("speed"), (p % 7).alias("FFTT"), F.when(p % 3 == 0, "").otherwise("60").alias("free_speed"))
    rows.write.option("header", True).csv(path)
    return src.dtalite_links(spark, path)


@query("src_matsim_events", views.with_views("link_events", "SELECT type, CAST(t // 1000000 AS DOUBLE) AS t, CAST(link AS VARCHAR) AS link, CAST(veh AS VARCHAR) AS veh FROM link_events"))
def src_matsim_events(spark, sf_dir):
    path = _path(spark, "events")
    rows = views.link_events(spark, sf_dir)
    who = F.col("veh").cast("string")
    line = doc.element(
        "event",
        {
            "time": F.floor(F.col("t") / 1_000_000), "type": F.when(F.col("type") == "entered", "entered link").otherwise("left link"), "link": F.col("link"),
            "vehicle": F.when(F.col("veh") % 2 == 0, who), "person": F.when(F.col("veh") % 2 == 1, who),
        },
    )
    other = doc.element("event", {"time": F.lit(1), "type": F.lit("actend"), "link": F.lit(1), "vehicle": who})
    body = doc.section(0, rows, F.lpad(F.col("pos").cast("string"), 20, "0"), line).union(doc.section(1, rows.where("pos % 5 = 0"), F.col("pos"), other))
    doc.write(doc.document(body), path)
    return src.matsim_events(spark, path).drop("pos")


#: Runs of all scenarios and seeds that share a number of their files.
RUNS_A_BLOCK = 500_000


#: Result files.
def _results(spark, sf_dir):
    """Result files of the runs: half of them in the old form, whose runs are named by their id alone."""
    path = _path(spark, "results")
    runs = views.runs(spark, sf_dir)
    travel = F.struct(F.struct(F.col("tt_mean").alias("mean"), F.col("tt_p95").alias("p95"), "trip_count").alias("travel_time"))
    engine = F.when(F.col("engine") == "F", "sumo").otherwise("matsim")
    old = F.struct(F.concat_ws("_", "scenario", engine, "mode").alias("scenario_id"), F.col("seed").cast("int").alias("seed"), "status", "runtime_s", travel.alias("metrics"))
    new = F.struct("scenario", engine.alias("engine"), "mode", F.col("seed").cast("int").alias("seed"), "status", "runtime_s", travel.alias("metrics"))
    # files of a scenario and seed, more of them where there are more runs: a file is written and read as one row
    block = F.pmod(F.xxhash64(*runs.columns, F.monotonically_increasing_id()), F.lit(-(-runs.count() // RUNS_A_BLOCK) or 1))
    for kind, name, seeds in ((old, "runs", 0), (new, "results", 1)):
        rows = runs.withColumn("_block", block).where(F.col("seed") % 2 == seeds)
        files = rows.groupBy(F.concat_ws("-", "scenario", "seed", "_block").alias("run")).agg(F.collect_list(kind).alias(name))
        files.write.mode("append").partitionBy("run").json(path)
    return path


@query("src_results_json", views.with_views("runs", "SELECT scenario, CASE engine WHEN 'F' THEN 'sumo' ELSE 'matsim' END AS engine, mode, CAST(seed AS INTEGER) AS seed, status, runtime_s, tt_mean, tt_p95, trip_count FROM runs"))
def src_results_json(spark, sf_dir):
    return src.results_json(spark, _results(spark, sf_dir)).select("scenario", "engine", "mode", "seed", "status", "runtime_s", "tt_mean", "tt_p95", "trip_count")


for _name in ("src_results_json_plots", "snk_results_json"):

    @query(_name, views.with_views("runs", "SELECT scenario, CASE engine WHEN 'F' THEN 'sumo' ELSE 'matsim' END AS engine, mode, count(*) AS runs, count(*) FILTER (status = 'success') AS successes, round(avg(tt_mean), 4) AS mean_tt FROM runs GROUP BY ALL"))
    def _read_results(spark, sf_dir):
        rows = src.results_json(spark, _results(spark, sf_dir))
        return rows.groupBy("scenario", "engine", "mode").agg(F.count("*").alias("runs"), F.count(F.when(F.col("status") == "success", 1)).alias("successes"), numbers.rounded(F.avg("tt_mean"), 4).alias("mean_tt"))


@query("src_metadata_json", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS nodes FROM orders")
def src_metadata_json(spark, sf_dir):
    path = _path(spark, "metadata")
    rows = views.table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.struct("o_orderpriority", F.col("o_custkey").alias("nodes"))).alias("meta"))))
    rows.write.text(path)
    read = spark.read.option("mode", "PERMISSIVE").schema("id bigint, meta struct<o_orderpriority: string, nodes: string>").json(path)
    return read.select("id", F.col("meta.o_orderpriority").alias("priority"), F.col("meta.nodes").alias("nodes"))


@query("snk_feasibility_json", "SELECT o_orderstatus AS scenario, count(*) AS total_trips, count(*) FILTER (o_custkey % 3 = 0) AS feasible_trips FROM orders GROUP BY 1")
def snk_feasibility_json(spark, sf_dir):
    path = _path(spark, "feasibility")
    views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("scenario")).agg(F.count("*").alias("total_trips"), F.count(F.when(F.col("o_custkey") % 3 == 0, 1)).alias("feasible_trips")).write.json(path)
    return spark.read.schema("scenario string, total_trips bigint, feasible_trips bigint").json(path)


for _name in ("snk_routes_cache", "src_routes_cache"):

    @query(_name, f"WITH {_ROUTED} SELECT trip_id, array_to_string(links, ' ') AS links FROM rt")
    def _cache(spark, sf_dir):
        path = _path(spark, "routes-cache")
        routes = _routed(spark, sf_dir).select("trip_id", "links")
        routes.write.parquet(path)  # the commit makes it whole or absent
        cached = spark.read.schema(routes.schema).parquet(path)
        if cached.count() != routes.count():
            raise ValueError("the cache is not whole")
        return cached.withColumn("links", F.array_join("links", " "))


@query("snk_throughput_cache", views.with_views("link_events", "SELECT t // 3600000000 AS hour, link, count(*) AS n FROM link_events WHERE type = 'entered' GROUP BY ALL"))
def snk_throughput_cache(spark, sf_dir):
    path = _path(spark, "throughput")
    views.link_events(spark, sf_dir).where("type = 'entered'").groupBy(F.floor(F.col("t") / 3_600_000_000).alias("hour"), "link").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("hour bigint, link bigint, n bigint").json(path)


#: Tables of reports.
def _table_cells(spark, sf_dir):
    # a mode of its own for some failed runs, so that failed cells occur
    trial = F.when((F.col("status") == "failed") & (F.col("seed") == 7), "trial").otherwise(F.col("mode"))
    return statistics.cell_stats(views.runs(spark, sf_dir).withColumn("mode", trial))


_TABLE = f"WITH {views.SQL['runs'].replace('runs AS', 'all_runs AS')}, runs AS (SELECT * REPLACE (CASE WHEN status = 'failed' AND seed = 7 THEN 'trial' ELSE mode END AS mode) FROM all_runs), {_CELLS} "


@_document(
    "snk_markdown_tbl",
    _TABLE + _fixed("| Scenario | Engine | Mode | Runtime (s) | Trips | Avg TT (s) | R-Score |", "|----------|--------|------|-------------|-------|------------|---------|")
    + "UNION ALL SELECT CASE WHEN successes > 0 THEN printf('| %s | %s | %s | %.2f ± %.3f | %d | %.1f ± %.2f | ', scenario, engine, mode, mean_runtime, ci_runtime, CAST(floor(mean_trips) AS BIGINT), mean_tt, ci_tt) || CASE WHEN isnan(r) THEN 'nan' ELSE printf('%.4f', r) END || ' |' ELSE printf('| %s | %s | %s | FAILED | - | - | - |', scenario, engine, mode) END FROM cells",
)
def snk_markdown_tbl(spark, sf_dir):
    return out.markdown_table(_table_cells(spark, sf_dir))


@_document(
    "snk_latex",
    _TABLE + _fixed("\\begin{tabular}{llrrr}", "\\toprule", "Scenario & Engine & Runtime (s) & Trips & R-Score \\\\", "\\midrule", "\\bottomrule", "\\end{tabular}")
    + "UNION ALL SELECT '\\midrule' FROM (SELECT DISTINCT scenario FROM cells WHERE successes > 0) WHERE scenario <> (SELECT min(scenario) FROM cells WHERE successes > 0) "
    "UNION ALL SELECT printf('%s & %s/%s & %.2f $\\pm$ %.3f & %d & ', replace(scenario, '_', '\\_'), engine, mode, mean_runtime, ci_runtime, CAST(floor(mean_trips) AS BIGINT)) || CASE WHEN isnan(r) THEN 'n/a' ELSE printf('%.4f', r) END || ' \\\\' FROM cells WHERE successes > 0",
)
def snk_latex(spark, sf_dir):
    cells = _table_cells(spark, sf_dir).where("successes > 0").withColumn("trips", F.floor("mean_trips"))
    return out.latex_table(reports.with_breaks(cells))


#: Model files: buildings, households and people of the customers.
_MODEL = {
    "bld": "'bld ' || c_custkey || ' 2 3 0 ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'False' END || ' \"house: ' || c_mktsegment || '\" 100 ' || (c_custkey % 100) || '.0 ' || (c_custkey % 50) || '.0 ' || (c_custkey % 100 + 1) || '.0 ' || CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE CAST(c_custkey % 50 + 1 AS STRING) || '.0' END || ' 7 1.5 2.5 9 1'",
    "hld": "'hld ' || c_custkey || ' \"1,HU' || c_custkey || '\" 2 1 9 1 ' || (c_custkey * 10) || ' ' || CASE WHEN c_custkey % 5 = 0 THEN 4 ELSE 2 END || ' ' || (c_custkey * 2) || ' ' || (c_custkey * 2 + 1)",
    "per": "'per ' || (c_custkey * 2) || ' HU' || c_custkey || ' 1 ' || (c_custkey % 90) || ' 500 ' || (c_custkey % 60) || ' ' || (c_custkey % 13) || ' \"(1 5 28800 ' || c_custkey || ')' || CASE WHEN c_custkey % 4 = 0 THEN '(1 5 28800)' ELSE '(1 5 61200 ' || (c_custkey + 1) || ')' END || '\"'",
}


def _model_lines(spark, sf_dir):
    path = _path(spark, "model")
    base = views.table(spark, sf_dir, "customer")
    for kind, line in _MODEL.items():
        base.selectExpr(f"{line} AS line").write.mode("append").text(path)
    base.limit(1).selectExpr("'junk line' AS line").write.mode("append").text(path)
    return spark.read.text(path).select(F.col("value").alias("line"), F.regexp_extract("value", r"^\w+ (\d+)", 1).try_cast("long").alias("pos"))


@query("src_bld_line", "SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 2 = 0 AS is_home, 'house: ' || c_mktsegment AS kind, c_custkey % 50 + 0.5::DOUBLE AS lat, c_custkey % 100 + 0.5::DOUBLE AS lon FROM customer WHERE c_custkey % 19 <> 0")
def src_bld_line(spark, sf_dir):
    return src.buildings(_model_lines(spark, sf_dir)).select("id", "is_home", "kind", "lat", "lon")


@query("src_building_centroid", "SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 50 + 0.5::DOUBLE AS lat, c_custkey % 100 + 0.5::DOUBLE AS lon FROM customer WHERE c_custkey % 19 <> 0")
def src_building_centroid(spark, sf_dir):
    return src.buildings(_model_lines(spark, sf_dir)).select("id", "lat", "lon")


@query("src_hld_line", "SELECT CAST(c_custkey AS BIGINT) AS building, 'HU' || c_custkey AS serial, CAST(c_custkey * 10 AS BIGINT) AS income, (c_custkey * 2) || ' ' || (c_custkey * 2 + 1) AS people FROM customer")
def src_hld_line(spark, sf_dir):
    return src.households(_model_lines(spark, sf_dir)).select("building", "serial", "income", F.array_join(F.col("people").cast("array<string>"), " ").alias("people"))


@query("src_per_line", "SELECT CAST(c_custkey * 2 AS BIGINT) AS id, 'HU' || c_custkey AS household, CAST(c_custkey % 90 AS INTEGER) AS age, CAST(c_custkey % 60 AS INTEGER) AS commute_min, CAST(c_custkey % 13 AS INTEGER) AS code FROM customer")
def src_per_line(spark, sf_dir):
    return src.persons(_model_lines(spark, sf_dir)).select("id", "household", "age", "commute_min", "code")


@query("src_schedule", "SELECT CAST(c_custkey * 2 AS BIGINT) AS id, CAST(28800 AS BIGINT) AS time_s, CAST(c_custkey AS BIGINT) AS building FROM customer UNION ALL SELECT c_custkey * 2, 61200, c_custkey + 1 FROM customer WHERE c_custkey % 4 <> 0")
def src_schedule(spark, sf_dir):
    return src.persons(_model_lines(spark, sf_dir)).select("id", F.explode("schedule").alias("s")).select("id", "s.time_s", "s.building")


_KEPT = "c_custkey % 19 <> 0 AND c_custkey % 50 + 0.5 BETWEEN 10 AND 30 AND c_custkey % 100 + 0.5 BETWEEN 0 AND 70"


@query("src_modelgen", f"SELECT CAST(c_custkey * 2 AS BIGINT) AS id, 'HU' || c_custkey AS household FROM customer WHERE {_KEPT} AND c_custkey % 60 > 0 AND c_custkey % 13 IN (0, 1, 7, 8, 9)")
def src_modelgen(spark, sf_dir):
    return src.model(_model_lines(spark, sf_dir), (10.0, 30.0, 0.0, 70.0), ["car", "bike"])["persons"].select("id", "household")


@query("join_hld_bld", f"SELECT CAST(c_custkey AS BIGINT) AS building, 'HU' || c_custkey AS serial FROM customer WHERE {_KEPT}")
def join_hld_bld(spark, sf_dir):
    return src.model(_model_lines(spark, sf_dir), (10.0, 30.0, 0.0, 70.0), ["car"])["households"].select("building", "serial")


@query("flt_mode_persons", "SELECT CAST(c_custkey * 2 AS BIGINT) AS id FROM customer WHERE c_custkey % 60 > 0 AND c_custkey % 13 IN (1, 7, 8)")
def flt_mode_persons(spark, sf_dir):
    return src.persons(_model_lines(spark, sf_dir)).where("commute_min > 0 AND code IN (1, 7, 8)").select("id")


@query("join_person_home", "SELECT CAST(c_custkey * 2 AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS home FROM customer")
def join_person_home(spark, sf_dir):
    lines = _model_lines(spark, sf_dir)
    homes = src.households(lines).select("pos", "building", F.explode("people").alias("id")).groupBy("id").agg(F.max_by("building", "pos").alias("home"))
    return src.persons(lines).join(homes, "id").select("id", "home")


@query("join_dependents", "SELECT c_custkey * 2 AS id, (SELECT count(*) FROM customer d WHERE d.c_custkey // 4 = c.c_custkey // 4 AND d.c_custkey <> c.c_custkey AND d.c_custkey % 90 < 18) > 0 AS dependent FROM customer c".replace("SELECT c_custkey * 2", "SELECT CAST(c_custkey * 2 AS BIGINT)", 1))
def join_dependents(spark, sf_dir):
    people = src.persons(_model_lines(spark, sf_dir)).select("id", "age", F.floor(F.col("id") / 8).alias("family"))
    # children of a family are counted first: another one of it is a child unless the only child asks
    children = people.where("age < 18").groupBy("family").agg(F.count("*").alias("k"))
    own = F.when(F.col("age") < 18, 1).otherwise(0)
    return people.join(children, "family", "left").select("id", (F.coalesce("k", F.lit(0)) - own > 0).alias("dependent"))


for _name in ("src_modelgen_scan", "src_modelgen_dir"):

    @query(_name, "SELECT f AS file, count(*) AS bld, count(*) AS hld, count(*) AS per, count(*) FILTER (k IN (1, 7, 8)) AS car, count(*) FILTER (k BETWEEN 2 AND 6) AS transit, count(*) FILTER (k = 9) AS bike, count(*) FILTER (k = 10) AS walk FROM (SELECT c_custkey % 3 AS f, c_custkey % 13 AS k FROM customer) GROUP BY f")
    def _scan(spark, sf_dir):
        path = _path(spark, "models")
        for line in _MODEL.values():
            views.table(spark, sf_dir, "customer").selectExpr("c_custkey % 3 AS file", f"{line} AS line").write.mode("append").partitionBy("file").text(path)
        lines = spark.read.schema("value string, file long").text(path).withColumnRenamed("value", "line")
        return src.model_scan(lines)


#: Logs and folders of runs.
_TAPE = "'[ ' || l_linenumber || '/7] ' || CASE l_linestatus WHEN 'F' THEN 'SUMO' ELSE 'matsim' END || ' meso seed=' || (l_orderkey % 500) || ' ' || CASE WHEN l_tax > 0.05 THEN '✗ FAIL  out of memory' ELSE '✓ ' || l_partkey || '.5s wall ( ' || (l_partkey % 90) || 's engine)' END"
_TAPE_SQL = f"tp AS (SELECT lower(CASE l_linestatus WHEN 'F' THEN 'SUMO' ELSE 'matsim' END) AS engine, 'meso' AS mode, CAST(l_orderkey % 500 AS INTEGER) AS seed, CASE WHEN l_tax > 0.05::DOUBLE THEN 'failed' ELSE 'success' END AS status, CASE WHEN l_tax > 0.05::DOUBLE THEN 0 ELSE l_partkey + 0.5 END::DOUBLE AS wall_s, CASE WHEN l_tax > 0.05::DOUBLE THEN 0 ELSE l_partkey % 90 END::DOUBLE AS engine_s, CASE WHEN l_tax > 0.05::DOUBLE THEN 'out of memory' END AS error, row_number() OVER (PARTITION BY l_linestatus, l_orderkey % 500 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_tax DESC) AS k FROM lineitem)"


def _log(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").selectExpr(f"{_TAPE} AS line", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax) AS pos")
    return src.harness_log(rows.union(rows.limit(1).select(F.lit("noise").alias("line"), "pos")))


@query("src_harness_log", f"WITH {_TAPE_SQL} SELECT engine, mode, seed, status, wall_s, engine_s, error FROM tp WHERE k = 1")
def src_harness_log(spark, sf_dir):
    return _log(spark, sf_dir)


_DISK = "dk AS (SELECT engine, mode, seed, CASE WHEN seed % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN seed % 10 = 0 THEN 'parse failed' END AS error FROM tp WHERE k = 1 AND seed % 4 <> 3), ex AS (SELECT unnest(['sumo', 'matsim', 'dtalite']) AS engine, 'meso' AS mode, CAST(i AS INTEGER) AS seed FROM (SELECT DISTINCT l_orderkey % 500 AS i FROM lineitem))"


for _name in ("join_recover", "snk_recovered_json"):

    def _recover(spark, sf_dir, as_json=_name == "snk_recovered_json"):
        log = materialise(_log(spark, sf_dir), "log")  # read by three branches
        disk = log.where("seed % 4 <> 3").select("engine", "mode", "seed", F.when(F.col("seed") % 5 == 0, "failed").otherwise("success").alias("status"), F.when(F.col("seed") % 10 == 0, "parse failed").alias("error"))
        seeds = views.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("id")).distinct()
        expected = seeds.select(F.lit("s").alias("scenario"), F.explode(F.array(*map(F.lit, ("sumo", "matsim", "dtalite")))).alias("engine"), F.lit("meso").alias("mode"), F.col("id").cast("int").alias("seed"), F.lit(600).alias("timeout_s"))
        found = src.recovered(expected, disk, log).drop("scenario")
        if not as_json:
            return found
        path = _path(spark, "recovered")
        found.write.json(path)
        return spark.read.schema(found.schema).json(path)

    query(
        _name,
        f"WITH {_TAPE_SQL}, {_DISK}, jn AS (SELECT ex.*, coalesce(dk.status, 'failed') AS status, dk.error AS de, lg.status AS ls, lg.wall_s AS lw, lg.engine_s AS le FROM ex LEFT JOIN dk USING (engine, mode, seed) LEFT JOIN (SELECT * FROM tp WHERE k = 1) lg USING (engine, mode, seed)), "
        "er AS (SELECT *, CASE WHEN status = 'failed' THEN coalesce(de, CASE engine WHEN 'dtalite' THEN 'DTALITE timeout after 600s' ELSE 'Cell artifact missing: ' || engine END) END AS error FROM jn) "
        "SELECT engine, mode, seed, status, error, CASE WHEN status = 'success' AND ls = 'success' THEN le WHEN engine = 'dtalite' THEN 600 WHEN status = 'success' THEN coalesce(lw, 0) ELSE 0 END::DOUBLE AS runtime_s, "
        "CASE WHEN status = 'success' AND ls = 'success' THEN lw WHEN engine = 'dtalite' THEN 600 WHEN status = 'success' THEN coalesce(lw, 0) ELSE 0 END::DOUBLE AS cell_wall_s FROM er",
    )(_recover)


#: Runs of three engines, a file each: some cut short, some empty, some absent.
_RUN = "CAST(l_orderkey % 60 AS INT) AS seed, CASE l_linenumber % 3 WHEN 0 THEN 'sumo' WHEN 1 THEN 'matsim' ELSE 'dtalite' END AS engine, CASE WHEN l_orderkey % 2 = 0 THEN 'meso' ELSE 'micro' END AS mode"
_TRIP_LINE = {
    "sumo": "'<tripinfo id=\"veh_' || l_orderkey || '\" duration=\"' || CASE WHEN l_partkey % 9 = 0 THEN 'x' ELSE l_partkey || '.5' END || '\"/>'",
    "matsim": "l_orderkey || ';' || lpad(CAST(l_partkey % 3 AS STRING), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS STRING), 2, '0') || ':00'",
    "dtalite": "(l_partkey % 90) || ',' || CASE WHEN l_partkey % 10 = 0 THEN '' ELSE CAST(l_partkey % 4 AS STRING) END",
}
_HEAD = {"sumo": "<tripinfos>", "matsim": "person;trav_time", "dtalite": "travel_time,volume"}


def _cell_folder(spark, sf_dir):
    path = _path(spark, "cells")
    line = views.table(spark, sf_dir, "lineitem")
    for engine, text in _TRIP_LINE.items():
        rows = line.selectExpr(*_RUN.split(", CASE")[:1], *("CASE" + x for x in _RUN.split(", CASE")[1:]), f"{text} AS line").where(f"engine = '{engine}' AND seed % 7 <> 2")
        # a run's lines make one file; runs are small here
        by = rows.groupBy("engine", "mode", "seed").agg(F.concat_ws("\n", F.collect_list("line")).alias("body"))
        end = F.when(F.col("seed") % 7 == 1, "<tripinfo id=\"").otherwise("</tripinfos>") if engine == "sumo" else F.when(F.col("seed") % 7 == 1, "a;b:c:d" if engine == "matsim" else "a,b")
        whole = F.when(F.col("seed") % 7 == 3, F.lit(_HEAD[engine]) if engine != "sumo" else F.lit("")).otherwise(F.concat_ws("\n", F.lit(_HEAD[engine]), "body", end))
        kept = by.select("engine", "mode", "seed", whole.alias("text"))
        packed = kept.where("seed % 7 <> 4") if engine == "matsim" else kept
        write = lambda df, zipped: df.write.mode("append").option("lineSep", "\n").option("compression", "gzip" if zipped else "none").partitionBy("engine", "mode", "seed").text(path)
        write(packed.repartition("engine", "mode", "seed"), engine == "matsim")
        if engine == "matsim":
            write(kept.where("seed % 7 = 4").repartition("engine", "mode", "seed"), False)  # not packed, so not readable
    return path


_CELL_FILES = (
    f"tl AS (SELECT {_RUN}, l_partkey AS p FROM lineitem), pn AS (SELECT DISTINCT e.engine, mode, seed FROM tl, (SELECT unnest(['sumo', 'matsim', 'dtalite']) AS engine) e), "
    "tv AS (SELECT engine, mode, seed, CASE engine WHEN 'sumo' THEN CASE WHEN p % 9 <> 0 THEN p + 0.5 END WHEN 'matsim' THEN nullif(p % 3 * 3600 + p % 60 * 60, 0) ELSE nullif(p % 90, 0) * 60 END::DOUBLE AS t, CASE WHEN engine = 'dtalite' THEN CASE WHEN p % 10 = 0 THEN 1 ELSE p % 4 END ELSE 1 END AS w FROM tl), "
    "ok AS (SELECT *, sum(w) OVER (PARTITION BY engine, mode, seed ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM tv WHERE t IS NOT NULL AND w > 0), "
    "sm AS (SELECT engine, mode, seed, CAST(sum(w) AS BIGINT) AS n, sum(t * w) / sum(w) AS m FROM ok GROUP BY ALL), "
    "pp AS (SELECT engine, mode, seed, n, m, min(t) AS p FROM ok JOIN sm USING (engine, mode, seed) WHERE upto > CASE WHEN engine = 'matsim' THEN least(floor(0.95::DOUBLE * n), n - 1) ELSE floor(0.95::DOUBLE * (n - 1)) END GROUP BY ALL), "
    "bad AS (SELECT pn.*, n, m, p, CASE WHEN seed % 7 IN (1, 2) OR (seed % 7 = 3 AND engine <> 'dtalite') OR (seed % 7 = 4 AND engine = 'matsim') OR n IS NULL OR seed % 7 = 3 THEN 'failed' ELSE 'success' END AS status FROM pn LEFT JOIN pp USING (engine, mode, seed)) "
)


for _engine in ("sumo", "matsim", "dtalite"):

    @query(
        f"src_cell_{_engine}",
        f"WITH {_CELL_FILES} SELECT engine, mode, seed, status, CASE WHEN status = 'failed' THEN CASE WHEN seed % 7 = 2 OR seed % 7 = 3 THEN CASE engine WHEN 'sumo' THEN CASE WHEN seed % 7 = 3 THEN 'tripinfo parse failed' ELSE 'Cell artifact missing: tripinfo.xml' END WHEN 'matsim' THEN CASE WHEN seed % 7 = 3 THEN 'MATSim parser returned no stats' ELSE 'Cell artifact missing: output/output_trips.csv.gz' END ELSE 'DTALITE timeout after 600s' END "
        "ELSE CASE engine WHEN 'sumo' THEN 'tripinfo parse failed' WHEN 'matsim' THEN 'MATSim parse failed' ELSE 'DTALite parse failed' END END END AS error, CASE WHEN status = 'success' THEN n ELSE 0 END AS trips, round(CASE WHEN status = 'success' THEN m ELSE 0 END, 4) AS mean_tt, CASE WHEN status = 'success' THEN p ELSE 0 END::DOUBLE AS p95_tt "
        f"FROM bad WHERE engine = '{_engine}'",
    )
    def _cell(spark, sf_dir, engine=_engine):
        line = views.table(spark, sf_dir, "lineitem").selectExpr(*_RUN.split(", CASE")[:1], *("CASE" + x for x in _RUN.split(", CASE")[1:]))
        planned = line.select("mode", "seed").distinct().select(F.lit(engine).alias("engine"), "mode", "seed", F.lit(600).alias("timeout_s"))
        return statistics.rounded(cells.recovered(planned, cells.read(spark, _cell_folder(spark, sf_dir)).where(F.col("engine") == engine)))


#: Folders of cells in all layouts.
_FOLDERS = "CASE l_orderkey % 8 WHEN 0 THEN s || '_' || e || '_' || m || '_seed' || k || '/native_files' WHEN 1 THEN s || '/' || e || '/' || m || '/seed_' || k WHEN 2 THEN s || '/' || s || '/' || e || '/' || m || '/seed_' || k WHEN 3 THEN e || '/' || m || '/seed_' || k WHEN 4 THEN s || '/' || e || '/seed_' || k WHEN 5 THEN s || '/' || s || '/' || e || '/seed_' || k WHEN 6 THEN e || '/seed_' || k ELSE s || '/notes' END"
_PARTS = ["l_orderkey % 8 AS layout", "'city' || (l_orderkey % 3) AS s", "CASE l_linestatus WHEN 'F' THEN 'sumo' ELSE 'matsim' END AS e", "CASE WHEN l_linenumber % 2 = 0 THEN 'meso' ELSE 'micro' END AS m", "l_linenumber AS k", "l_orderkey"]
_CELLS_SQL = (
    f"WITH fp AS (SELECT DISTINCT {_FOLDERS} AS path, layout, s, e, m, k FROM (SELECT {', '.join(_PARTS)} FROM lineitem)), fc AS (SELECT DISTINCT path, CAST(layout AS INTEGER) AS layout, CASE WHEN layout IN (3, 6) THEN 'base' ELSE s END AS scenario, e AS engine, CASE WHEN layout IN (4, 5, 6) THEN NULL ELSE m END AS mode, CAST(k AS INTEGER) AS seed FROM fp WHERE layout < 7) "
)


def _cells(spark, sf_dir):
    paths = views.table(spark, sf_dir, "lineitem").selectExpr(*_PARTS).selectExpr(f"{_FOLDERS} AS path").distinct()
    return src.cells_of_paths(paths, "base")


@query("src_discover_cells", _CELLS_SQL + "SELECT path, layout, scenario, engine, mode, seed FROM fc")
def src_discover_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query("src_find_cell_dir", _CELLS_SQL + ", sp AS (SELECT path, layout, scenario, engine, seed, unnest(CASE WHEN mode IS NULL THEN ['meso', 'micro'] ELSE [mode] END) AS mode FROM fc) SELECT scenario, engine, mode, seed, arg_min(path, (layout, path)) AS path FROM sp GROUP BY ALL")
def src_find_cell_dir(spark, sf_dir):
    return src.find_cells(_cells(spark, sf_dir))


for _name in ("src_discover_scenarios", "set_layout_union"):

    @query(_name, _CELLS_SQL + "SELECT DISTINCT scenario FROM fc")
    def _scenarios(spark, sf_dir):
        return _cells(spark, sf_dir).select("scenario").distinct()


@query("src_discover_modes", _CELLS_SQL + "SELECT DISTINCT scenario, coalesce(mode, 'meso') AS mode FROM fc")
def src_discover_modes(spark, sf_dir):
    return _cells(spark, sf_dir).select("scenario", F.coalesce("mode", F.lit("meso")).alias("mode")).distinct()
