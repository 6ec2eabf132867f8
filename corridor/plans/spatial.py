"""Queries on places, polylines, signals and network attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import views
from corridor.functions import geo, numbers, roads
from corridor.operators import network, ranges, signals, spatial
from corridor.operators.statistics import rounded
from corridor.plans.derived import frame, sql
from corridor.registry import query

_POINTS = "CAST({a} AS BIGINT) AS id, CAST({e}[{i}] AS DOUBLE) * 0.01 + 40 AS lat, CAST({e}[{j}] AS DOUBLE) * 0.01 - 80 AS lon"
_KM = "12742.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(n.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - b.lon) / 2), 2))))"


def _points(spark, sf_dir):
    table = views.table(spark, sf_dir, "embeddings")
    key = table.columns[0]
    return table.select(F.col(key).cast("long").alias("id"), *((F.col("embedding")[i].cast("double") * F.lit(0.1) + base).alias(n) for i, n, base in ((0, "lat", 40.0), (1, "lon", -80.0))))


def _point_sql(select):
    return f"WITH p AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) * 0.1::DOUBLE + 40 AS lat, CAST(embedding[2] AS DOUBLE) * 0.1::DOUBLE - 80 AS lon FROM embeddings), b AS (SELECT * FROM p WHERE id % 2 = 0), n AS (SELECT *, id AS pos FROM p WHERE id % 2 = 1) {select}"


def _sides(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumn("pos", F.col("id"))


@query(
    "join_nearest_node",
    _point_sql(
        f", d AS (SELECT b.id, n.id AS site, n.pos, {_KM} AS km FROM b, n WHERE abs(trunc(b.lat / 0.005) - trunc(n.lat / 0.005)) <= 1 AND abs(trunc(b.lon / 0.005) - trunc(n.lon / 0.005)) <= 1) "
        "SELECT id, arg_min(site, (km, pos)) AS site, round(min(km), 6) AS km FROM d WHERE km <= 0.5 GROUP BY id"
    ),
)
def join_nearest_node(spark, sf_dir):
    return rounded(spatial.nearest_in_grid(*_sides(spark, sf_dir), size=0.005, max_km=0.5), 6)


@query("join_nearest_school", _point_sql(f", d AS (SELECT b.id, n.id AS site, n.pos, {_KM} AS km FROM b, n WHERE n.id % 5 = 0) SELECT id, arg_min(site, (km, pos)) AS site, round(min(km), 6) AS km FROM d WHERE km <= 1.5 GROUP BY id"))
def join_nearest_school(spark, sf_dir):
    homes, sites = _sides(spark, sf_dir)
    return rounded(spatial.nearest_within(homes, sites.where("id % 5 = 0"), max_km=1.5), 6)


@query("agg_bbox", _point_sql("SELECT min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM p"))
def agg_bbox(spark, sf_dir):
    return spatial.box_of(_points(spark, sf_dir))


@query("flt_bbox_point", _point_sql("SELECT id FROM p WHERE lat BETWEEN 39.99 AND 40.01 AND lon BETWEEN -80.005 AND -79.99"))
def flt_bbox_point(spark, sf_dir):
    return _points(spark, sf_dir).where("lat BETWEEN 39.99 AND 40.01 AND lon BETWEEN -80.005 AND -79.99").select("id")


@query("flt_bbox_intersect", sql("boxes", "SELECT id FROM f WHERE NOT (lon + radius < 10 OR lon > 30 OR lat + radius < -5 OR lat > 12)"))
def flt_bbox_intersect(spark, sf_dir):
    return frame(spark, sf_dir, "boxes").where("lon + radius >= 10 AND lon <= 30 AND lat + radius >= -5 AND lat <= 12").select("id")


@query("src_census_state", sql("boxes", ", s AS (SELECT n_nationkey AS state, n_nationkey * 12 - 150 AS west, n_nationkey * 12 - 130 AS east FROM nation) SELECT id, CAST(min(state) AS BIGINT) AS state FROM f JOIN s ON lon - radius >= west AND lon + radius <= east GROUP BY id"))
def src_census_state(spark, sf_dir):
    states = views.table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS state", "n_nationkey * 12 - 150 AS west", "n_nationkey * 12 - 130 AS east")
    cells = states.select("*", F.explode(F.sequence(F.floor(F.col("west") / 10), F.floor(F.col("east") / 10))).alias("c"))
    boxes = frame(spark, sf_dir, "boxes").withColumn("c", F.floor(F.col("lon") / 10))  # a box lies in a state only if its centre does
    return boxes.join(cells, "c").where("lon - radius >= west AND lon + radius <= east").groupBy("id").agg(F.min("state").alias("state"))


@query("val_bbox", sql("boxes", "SELECT id, CASE WHEN lat - 30 >= radius THEN 'north_south' ELSE 'east_west' END AS rule FROM f WHERE lat - 30 >= radius OR lon - 100 >= radius"))
def val_bbox(spark, sf_dir):
    rule = F.when(F.col("lat") - 30 >= F.col("radius"), "north_south").when(F.col("lon") - 100 >= F.col("radius"), "east_west")
    return frame(spark, sf_dir, "boxes").select("id", rule.alias("rule")).where("rule IS NOT NULL")


#: Tracts: diamonds around 25 places, which overlap.
_TRACTS = "tracts AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 - 2 AS cx, n_nationkey // 5 - 2 AS cy FROM nation), q AS (SELECT id, (lon + 80) * 100 AS x, (lat - 40) * 100 AS y, id % 3 + 1 AS w FROM p), h AS (SELECT q.id, min(t.id) AS polygon FROM q JOIN tracts t ON abs(x - cx) + abs(y - cy) < 0.7 GROUP BY q.id)"


def _tracts(spark, sf_dir):
    place = views.table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "CAST(n_nationkey % 5 - 2 AS DOUBLE) AS cx", "CAST(n_nationkey DIV 5 - 2 AS DOUBLE) AS cy")
    corner = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    return place.select("id", F.col("id").alias("pos"), F.array(corner(0.7, 0.0), corner(0.0, 0.7), corner(-0.7, 0.0), corner(0.0, -0.7)).alias("ring"))


def _located(spark, sf_dir):
    points = _points(spark, sf_dir).select("id", ((F.col("lon") + 80) * 100).alias("x"), ((F.col("lat") - 40) * 100).alias("y"), (F.col("id") % 3 + 1).alias("w"))
    return points.join(spatial.first_polygon(points, _tracts(spark, sf_dir), 1.0), "id")


@query("join_point_in_polygon", _point_sql(f", {_TRACTS} SELECT id, polygon FROM h"))
def join_point_in_polygon(spark, sf_dir):
    return _located(spark, sf_dir).select("id", "polygon")


for _name in ("agg_tract_counts", "map_od"):

    @query(_name, _point_sql(f", {_TRACTS} SELECT polygon, CAST(sum(w) AS BIGINT) AS trips FROM h JOIN q USING (id) GROUP BY polygon"))
    def _counts(spark, sf_dir):
        return _located(spark, sf_dir).groupBy("polygon").agg(F.sum("w").cast("long").alias("trips"))


for _name in ("join_tract_tt", "agg_tract_mean_tt", "map_tt"):

    @query(_name, _point_sql(f", {_TRACTS} SELECT polygon, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * (id % 100)) AS BIGINT) AS total, round(sum(w * (id % 100)) / sum(w), 6) AS mean_tt FROM h JOIN q USING (id) GROUP BY polygon"))
    def _means(spark, sf_dir):
        by = _located(spark, sf_dir).groupBy("polygon").agg(F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * (F.col("id") % 100)).cast("long").alias("total"))
        return by.withColumn("mean_tt", numbers.rounded(F.col("total") / F.col("n"), 6))


#: Polylines: the lines of an order in turn.
_LINES = "pts AS (SELECT CAST(l_orderkey AS BIGINT) AS line, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_quantity AS DOUBLE) AS x, CAST(l_partkey % 100 AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1)"


def _lines(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem")
    first = line.groupBy(F.col("l_orderkey").cast("long").alias("line"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("b"))
    return first.select("line", "pos", F.col("b.l_quantity").cast("double").alias("x"), (F.col("b.l_partkey") % 100).cast("double").alias("y"))


_ARC = f"WITH {_LINES}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM pts WINDOW w AS (PARTITION BY line ORDER BY pos)), a AS (SELECT line, pos, x, y, sum(step) OVER (PARTITION BY line ORDER BY pos) AS upto FROM s)"


@query("win_arc_length", _ARC + " SELECT line, pos, x, y, round(upto, 6) AS upto FROM a")
def win_arc_length(spark, sf_dir):
    return rounded(spatial.arc_lengths(_lines(spark, sf_dir)), 6)


@query(
    "win_interpolate",
    _ARC + ", c AS (SELECT *, max(upto) OVER (PARTITION BY line) * 0.37 AS goal, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(upto) OVER w AS nu FROM a WINDOW w AS (PARTITION BY line ORDER BY pos)), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos DESC) AS k FROM c WHERE upto <= goal AND (nu IS NULL OR nu > goal)) "
    "SELECT line, round(CASE WHEN nu IS NULL THEN x ELSE x + (nx - x) * (goal - upto) / (nu - upto) END, 4) AS x, round(CASE WHEN nu IS NULL THEN y ELSE y + (ny - y) * (goal - upto) / (nu - upto) END, 4) AS y FROM h WHERE k = 1",
)
def win_interpolate(spark, sf_dir):
    return rounded(spatial.along(_lines(spark, sf_dir), F.lit(0.37)))


#: Links with the attributes of a road network, in Spark's SQL and DuckDB's alike.
_ROAD = "CASE link_pos % 17 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "footway", "path", "steps", "track", "cycleway", "living_street", "unclassified", "motorway_link"))) + " ELSE 'other_road' END"
_ATTR = ["*", f"{_ROAD} AS road", "CAST(link_pos % 4 + 1 AS INT) AS lanes", "CAST(link_pos % 30 + 5 AS DOUBLE) AS speed", "CASE link_pos % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS scenario"]


def _roads(spark, sf_dir):
    return views.links(spark, sf_dir).selectExpr(*_ATTR)


def _road_sql(select):
    return views.with_views("links", f", r AS (SELECT {', '.join(_ATTR)} FROM links) {select}")


for _name in ("agg_network_stats", "val_network_stats"):

    @query(_name, _road_sql("SELECT scenario, count(*) AS links, min(speed) AS min_speed, max(speed) AS max_speed, round(avg(speed), 6) AS mean_speed, min(lanes) AS min_lanes, max(lanes) AS max_lanes, round(avg(lanes), 6) AS mean_lanes, count(DISTINCT road) AS classes FROM r GROUP BY scenario"))
    def _stats(spark, sf_dir):
        by = _roads(spark, sf_dir).groupBy("scenario").agg(
            F.count("*").alias("links"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.avg("speed").alias("mean_speed"),
            F.min("lanes").alias("min_lanes"), F.max("lanes").alias("max_lanes"), F.avg("lanes").alias("mean_lanes"), F.count_distinct("road").alias("classes"),
        )
        return rounded(by, 6)


_RANK = ", c AS (SELECT road, count(*) AS n, min(link_pos) AS first_pos FROM r GROUP BY road), k AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, first_pos) AS INTEGER) AS place FROM c)"


@query("win_rank_classes", _road_sql(_RANK + " SELECT road, n, place FROM k"))
def win_rank_classes(spark, sf_dir):
    return network.ranked_classes(_roads(spark, sf_dir)).select("road", "n", "place")


@query("topk_classes", _road_sql(_RANK + " SELECT road, n FROM k WHERE place <= 12"))
def topk_classes(spark, sf_dir):
    return network.ranked_classes(_roads(spark, sf_dir)).where("place <= 12").select("road", "n")


@query("agg_road_classes", _road_sql(_RANK + ", w AS (SELECT CASE WHEN place <= 12 THEN road ELSE '(other x ' || (SELECT count(*) FROM k WHERE place > 12) || ')' END AS class, scenario FROM r JOIN k USING (road)) SELECT class, count(*) FILTER (scenario = 'a') AS a, count(*) FILTER (scenario = 'b') AS b, count(*) FILTER (scenario = 'c') AS c FROM w GROUP BY class"))
def agg_road_classes(spark, sf_dir):
    wide = network.class_table(_roads(spark, sf_dir)).groupBy("class").pivot("scenario", ["a", "b", "c"]).agg(F.count("link_id"))
    return wide.select("class", *(F.coalesce(c, F.lit(0)).alias(c) for c in "abc"))


@query("flt_degenerate_links", views.with_views("links", "SELECT count(*) AS links, count(*) FILTER (from_node = to_x) AS self_loops, count(*) FILTER (from_node <> to_x AND x <= 0) AS no_length, count(*) FILTER (from_node <> to_x AND x > 0) AS kept FROM (SELECT *, CASE WHEN link_pos % 11 = 0 THEN from_node ELSE to_node END AS to_x, CASE WHEN link_pos % 7 = 0 THEN 0 ELSE length END AS x FROM links)"))
def flt_degenerate_links(spark, sf_dir):
    rows = views.links(spark, sf_dir).selectExpr("link_id", "from_node", "CASE WHEN link_pos % 11 = 0 THEN from_node ELSE to_node END AS to_node", "CASE WHEN link_pos % 7 = 0 THEN 0.0D ELSE length END AS length")
    return network.degenerate_counts(rows)


@query("flt_highway", _road_sql("SELECT CASE WHEN road IN ('motorway', 'trunk', 'motorway_link') THEN 1.0 WHEN road IN ('primary', 'secondary') THEN 0.7 WHEN road IN ('service', 'track', 'living_street') THEN 0.25 WHEN road = 'cycleway' THEN 0.15 ELSE 0.4 END::DOUBLE AS width, count(*) AS links FROM r WHERE road NOT IN ('footway', 'path', 'steps') GROUP BY 1"))
def flt_highway(spark, sf_dir):
    drawn = _roads(spark, sf_dir).where("road NOT IN ('footway', 'path', 'steps')")
    return drawn.groupBy(roads.line_width(F.col("road")).alias("width")).agg(F.count("*").alias("links"))


_DEGREE = ", d AS (SELECT node, count(*) AS degree FROM (SELECT from_node AS node FROM links UNION ALL SELECT to_node FROM links) GROUP BY node)"


@query("prj_node_type", views.with_views("links", _DEGREE + " SELECT node, CASE WHEN degree <= 2 THEN 'dead_end' WHEN degree >= 6 THEN 'major_intersection' ELSE 'intersection' END AS type FROM d"))
def prj_node_type(spark, sf_dir):
    return network.degree(views.links(spark, sf_dir)).select("node", roads.node_type(F.col("degree")).alias("type"))


def _signal_nodes(spark, sf_dir, tagged):
    tag = F.substring("node", 2, 9).cast("int") % 9 == 0 if tagged else F.lit(False)
    return network.degree(views.links(spark, sf_dir)).withColumn("has_signal", tag)


@query("flt_signal_nodes", views.with_views("links", _DEGREE + " SELECT node FROM d WHERE CAST(substr(node, 2) AS INTEGER) % 9 = 0"))
def flt_signal_nodes(spark, sf_dir):
    return signals.signal_nodes(_signal_nodes(spark, sf_dir, True))


@query("topk_signals", views.with_views("links", _DEGREE + " SELECT node FROM d WHERE degree >= 4 ORDER BY degree DESC, node LIMIT 20"))
def topk_signals(spark, sf_dir):
    return signals.signal_nodes(_signal_nodes(spark, sf_dir, False), most=20)


_TURN = ", o AS (SELECT to_node AS node, link_pos, link_id, row_number() OVER (PARTITION BY to_node ORDER BY link_pos) % 2 AS t FROM links), g AS (SELECT node, coalesce(string_agg(link_id, ' ' ORDER BY link_pos) FILTER (t = 1), '') AS group_1, coalesce(string_agg(link_id, ' ' ORDER BY link_pos) FILTER (t = 0), '') AS group_2 FROM o GROUP BY node)"


@query("win_alternate", views.with_views("links", _TURN + " SELECT node, group_1, group_2 FROM g"))
def win_alternate(spark, sf_dir):
    return signals.alternating(views.links(spark, sf_dir)).select("node", *(F.array_join(c, " ").alias(c) for c in ("group_1", "group_2")))


_PHASES = " SELECT node, 90 AS cycle_s, unnest(['p1', 'p1y', 'ar1', 'p2', 'p2y', 'ar2']) AS phase, unnest([40, 3, 2, 40, 3, 2]) AS seconds, unnest(['G', 'y', 'r', 'G', 'y', 'r']) AS state, unnest([group_1, group_1, '', group_2, group_2, '']) AS links FROM "


def _phase_rows(found):
    return found.select("node", "cycle_s", F.explode("phases").alias("p")).select("node", "cycle_s", "p.phase", "p.seconds", "p.state", F.array_join("p.links", " ").alias("links"))


@query("gen_controller", views.with_views("links", _TURN + _PHASES + "g"))
def gen_controller(spark, sf_dir):
    links = views.links(spark, sf_dir)
    return _phase_rows(signals.controllers(links.select(F.col("to_node").alias("node")).distinct(), links))


@query("gen_signals", views.with_views("links", _DEGREE + _TURN + _PHASES + "(SELECT d.node, coalesce(group_1, '') AS group_1, coalesce(group_2, '') AS group_2 FROM d LEFT JOIN g USING (node) WHERE degree >= 4)"))
def gen_signals(spark, sf_dir):
    return _phase_rows(signals.controllers(signals.signal_nodes(_signal_nodes(spark, sf_dir, False)), views.links(spark, sf_dir)))


@query("agg_signal_stats", views.with_views("links", _DEGREE + ", s AS (SELECT * FROM d WHERE degree >= 4) SELECT count(*) AS junctions, min(90) AS least_cycle, max(90) AS most_cycle, CAST(count(*) * 6 AS BIGINT) AS phases FROM s"))
def agg_signal_stats(spark, sf_dir):
    found = signals.controllers(signals.signal_nodes(_signal_nodes(spark, sf_dir, False)), views.links(spark, sf_dir))
    return found.agg(F.count("*").alias("junctions"), F.min("cycle_s").alias("least_cycle"), F.max("cycle_s").alias("most_cycle"), F.sum(F.size("phases")).cast("long").alias("phases"))


@query("topk_zero_links", views.with_views("links", "SELECT link_id FROM links WHERE link_pos % 7 = 0 ORDER BY link_pos LIMIT 10"))
def topk_zero_links(spark, sf_dir):
    return views.links(spark, sf_dir).where("link_pos % 7 = 0").orderBy("link_pos").limit(10).select("link_id")


@query("win_movement_id", views.with_views("links", f" SELECT 'm' || (row_number() OVER (ORDER BY to_node, link_id) - 1) AS mvmt_id, to_node AS via_node, link_id FROM links WHERE link_pos % 3 = 0"))
def win_movement_id(spark, sf_dir):
    rows = views.links(spark, sf_dir).where("link_pos % 3 = 0").select(F.col("to_node").alias("via_node"), "link_id")
    found = ranges.numbered(rows, ["via_node", "link_id"], F.substring("via_node", 1, 3), "k")
    return found.select(F.concat(F.lit("m"), "k").alias("mvmt_id"), "via_node", "link_id")


#: Node paths: an order's parts in turn.
_STEPS = "steps AS (SELECT path, pos, 'n' || node AS node FROM (SELECT l_orderkey AS path, l_linenumber AS pos, min(l_partkey % 40) AS node FROM lineitem GROUP BY ALL)), fl AS (SELECT from_node, to_node, arg_min(link_id, link_pos) AS link_id FROM links GROUP BY ALL), pairs AS (SELECT path, pos, node, lead(node) OVER (PARTITION BY path ORDER BY pos) AS next FROM steps), tied AS (SELECT path, pos, link_id FROM pairs LEFT JOIN fl ON node = from_node AND next = to_node WHERE next IS NOT NULL)"


def _tied(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem")
    steps = line.groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos")).agg(F.concat(F.lit("n"), F.min(F.col("l_partkey") % 40)).alias("node"))
    return network.links_of_steps(steps, views.links(spark, sf_dir))


@query("win_pairs", views.with_views("links", f", {_STEPS} SELECT path, pos, link_id FROM tied"))
def win_pairs(spark, sf_dir):
    return _tied(spark, sf_dir)


@query("gr_node_to_link", views.with_views("links", f", {_STEPS} SELECT path, string_agg(link_id, ' ' ORDER BY pos) AS links FROM tied GROUP BY path HAVING count(*) = count(link_id)"))
def gr_node_to_link(spark, sf_dir):
    return network.link_paths(_tied(spark, sf_dir)).withColumn("links", F.array_join("links", " "))


@query("join_link_endpoints", views.with_views("links", ", m AS (SELECT link_id, count(*) AS volume FROM links WHERE link_pos % 2 = 0 GROUP BY 1), n AS (SELECT 'n' || i AS node, CAST(i AS DOUBLE) / 10 AS x, CAST(i * 7 % 100 AS DOUBLE) AS y FROM range(0, 400) t(i)) SELECT l.link_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, coalesce(volume, 0) AS volume FROM links l JOIN n a ON l.from_node = a.node JOIN n b ON l.to_node = b.node LEFT JOIN m USING (link_id)"))
def join_link_endpoints(spark, sf_dir):
    links = views.links(spark, sf_dir)
    nodes = spark.range(400).select(F.concat(F.lit("n"), "id").alias("node"), (F.col("id").cast("double") / 10).alias("x"), (F.col("id") * 7 % 100).cast("double").alias("y"))
    metric = links.where("link_pos % 2 = 0").groupBy("link_id").agg(F.count("*").alias("volume"))
    return network.with_endpoints(links, nodes, metric)
