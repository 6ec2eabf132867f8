"""Networks made of ways, and the shapes of links along them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corridor import views
from corridor.functions import numbers
from corridor.operators import ways
from corridor.operators.statistics import rounded
from corridor.plans.projections import _READ, _SPEEDS
from corridor.registry import query
from corridor.session import shared_dir

#: Ways: the lines of an order in turn, of which some pass a vertex that others share.
_NODE = "CASE WHEN p % 3 = 0 THEN p % 700 ELSE 1000000 + way * 10 + pos END AS node"
_XY = ["way", "pos", "node", "CASE WHEN node % 50 = 0 THEN 0.5 ELSE node * 37 % 10007 / 10000.0D END AS x", "40 + CASE WHEN node % 50 = 0 THEN 0.5 ELSE node * 91 % 10009 / 10000.0D END AS y"]
_TAGS = [
    "CAST(o_orderkey AS BIGINT) AS way", "CASE o_orderkey % 5 WHEN 0 THEN 'service,residential' WHEN 1 THEN 'motorway' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'secondary' ELSE 'residential' END AS roads", "CASE o_orderkey % 4 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN 'walk' END AS maxspeed",
    "CASE o_orderkey % 3 WHEN 0 THEN '4' WHEN 1 THEN 'x' END AS lanes", "o_orderpriority AS name", "o_orderkey % 6 = 0 AS oneway",
]
_WAYS = (
    "WITH vs AS (SELECT CAST(l_orderkey AS BIGINT) AS way, CAST(l_linenumber AS BIGINT) AS pos, min(l_partkey) AS p FROM lineitem GROUP BY ALL), vn AS (SELECT way, pos, " + _NODE + " FROM vs), "
    f"vx AS (SELECT {', '.join(_XY).replace('10000.0D', '10000.0::DOUBLE')} FROM vn), tg AS (SELECT {', '.join(_TAGS)} FROM orders), "
    "fq AS (SELECT node, count(*) AS n FROM vx GROUP BY node), st AS (SELECT vx.*, n, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(node) OVER w IS NULL AS last FROM vx JOIN fq USING (node) WINDOW w AS (PARTITION BY way ORDER BY pos)), "
    "up AS (SELECT *, sum(coalesce(12742000.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(y - py) / 2), 2) + cos(radians(py)) * cos(radians(y)) * pow(sin(radians(x - px) / 2), 2)))), 0)) OVER (PARTITION BY way ORDER BY pos) AS upto FROM st), "
    "sg AS (SELECT way, pos, node AS u, lead(node) OVER w AS v, lead(upto) OVER w - upto AS length_m FROM up WHERE n > 1 OR px IS NULL OR last WINDOW w AS (PARTITION BY way ORDER BY pos)), "
    "bo AS (SELECT way, pos, u, v, length_m, 0 AS back FROM sg WHERE v IS NOT NULL UNION ALL SELECT way, pos, v, u, length_m, 1 FROM sg JOIN tg USING (way) WHERE v IS NOT NULL AND NOT oneway), "
    "dg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM bo UNION ALL SELECT v FROM bo) GROUP BY node), "
    "nd AS (SELECT 'n' || (row_number() OVER (ORDER BY node) - 1) AS id, node AS osm_id, x, y, CASE WHEN degree <= 2 THEN 'dead_end' WHEN degree >= 6 THEN 'major_intersection' ELSE 'intersection' END AS type, node % 4 = 0 AS has_signal FROM dg JOIN (SELECT node, min(x) AS x, min(y) AS y FROM vx GROUP BY node) USING (node)), "
    "lk AS (SELECT row_number() OVER (ORDER BY u, v, way, pos, back) - 1 AS k, a.id AS from_node, b.id AS to_node, length_m, way, lanes, maxspeed, CASE WHEN roads LIKE '%,%' THEN 'residential' ELSE roads END AS road, name FROM bo JOIN tg USING (way) JOIN nd a ON a.osm_id = u JOIN nd b ON b.osm_id = v WHERE u <> v AND length_m > 0) "
)


def _vertices(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("way"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey")
    first = line.repartition("way").groupBy("way", "pos").agg(F.min("l_partkey").alias("p"))  # by way, as what follows wants it
    return first.selectExpr("way", "pos", _NODE).selectExpr(*_XY)


def _tags(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").selectExpr(*_TAGS).withColumn("highway", F.split("roads", ",")).drop("roads")


def _signals(spark, sf_dir):
    return _vertices(spark, sf_dir).where("node % 4 = 0").select("node")


def _cuts(spark, sf_dir):
    return ways.cuts(_vertices(spark, sf_dir), _tags(spark, sf_dir))


@query("gen_network", _WAYS + f"SELECT 'l' || k AS id, k AS link_pos, from_node, to_node, round(length_m, 4) AS length_m, coalesce(CASE WHEN regexp_full_match(trim(lanes), '[+-]?[0-9]+') THEN CAST(trim(lanes) AS INTEGER) END, CASE road WHEN 'motorway' THEN 3 WHEN 'secondary' THEN 2 ELSE 1 END) AS lanes, round_even(coalesce(CASE WHEN lower(maxspeed) LIKE '%mph%' THEN {_READ} * 0.44704::DOUBLE ELSE {_READ} / 3.6::DOUBLE END, {_SPEEDS}), 1) AS speed_mps, road AS highway, way AS osm_way_id, name FROM lk")
def gen_network(spark, sf_dir):
    return rounded(ways.network(_vertices(spark, sf_dir), _tags(spark, sf_dir), _signals(spark, sf_dir))[1])


@query("gen_network_nodes", _WAYS + "SELECT id, osm_id, round(x, 4) AS x, round(y, 4) AS y, type, has_signal FROM nd")
def gen_network_nodes(spark, sf_dir):
    return rounded(ways.nodes_of(_cuts(spark, sf_dir), _signals(spark, sf_dir)).drop("k"))


@query("gen_network_restrictions", _WAYS + ", rl AS (SELECT 'no_left_turn' AS type, min(way) AS from_way, node AS via, max(way) AS to_way FROM vx GROUP BY node HAVING count(DISTINCT way) > 1), fi AS (SELECT way, to_node AS nd, 'l' || min(k) AS f FROM lk GROUP BY ALL), fo AS (SELECT way, from_node AS nd, 'l' || min(k) AS t FROM lk GROUP BY ALL) SELECT rl.type, f AS from_link, id AS via_node, t AS to_link FROM rl JOIN nd ON osm_id = via JOIN fi ON fi.way = from_way AND fi.nd = id JOIN fo ON fo.way = to_way AND fo.nd = id".replace(") , rl", "), rl"))
def gen_network_restrictions(spark, sf_dir):
    cut = _cuts(spark, sf_dir)
    nodes = ways.nodes_of(cut, _signals(spark, sf_dir))
    links = ways.links_of(cut, nodes, _tags(spark, sf_dir).select("way", "oneway"))
    # vertices of two ways are all among the cuts
    by = cut.groupBy(F.col("node").alias("via")).agg(F.min("way").alias("from_way"), F.max("way").alias("to_way")).where("from_way <> to_way")
    return ways.restrictions(by.select(F.lit("no_left_turn").alias("type"), "from_way", "via", "to_way"), nodes, links)


#: Links between two vertices of a way: some against it, some a little or too far off it, some unknown, some with both ends on one vertex.
_OFF = "CASE way % 7 WHEN 1 THEN 0.000005D WHEN 2 THEN 0.0001D ELSE 0 END"
_LINK = ["'l' || way AS link_id", "CASE WHEN way % 2 = 0 THEN ax ELSE zx END + {off} AS x1", "CASE WHEN way % 2 = 0 THEN ay ELSE zy END AS y1", "CASE WHEN way % 11 = 3 THEN CASE WHEN way % 2 = 0 THEN ax ELSE zx END WHEN way % 2 = 0 THEN zx ELSE ax END AS x2", "CASE WHEN way % 11 = 3 THEN CASE WHEN way % 2 = 0 THEN ay ELSE zy END WHEN way % 2 = 0 THEN zy ELSE ay END AS y2", "way % 13 <> 4 AS known"]
_SHAPE = (
    _WAYS.split(", fq AS")[0].rstrip() + ", ge AS (SELECT way, list({'x': x, 'y': y} ORDER BY pos) AS points FROM vx GROUP BY way HAVING count(*) > 1), en AS (SELECT way, points[1].x AS ax, points[1].y AS ay, points[-1].x AS zx, points[-1].y AS zy FROM ge), "
    f"li AS (SELECT {', '.join(_LINK).format(off=_OFF).replace('0.000005D', '0.000005::DOUBLE').replace('0.0001D', '0.0001::DOUBLE')}, [way + 1, way] AS ways FROM en), "
    "ex AS (SELECT li.*, unnest(ways) AS way, unnest([0, 1]) AS rank FROM li WHERE known), tr AS (SELECT ex.*, points, list_min(list_filter(list_transform(range(0, len(points)), lambda i: {'d': pow(points[i + 1].x - x1, 2) + pow(points[i + 1].y - y1, 2), 'i': i}), lambda s: s.d < 1e-5::DOUBLE * 1e-5::DOUBLE)).i AS a, "
    "list_min(list_filter(list_transform(range(0, len(points)), lambda i: {'d': pow(points[i + 1].x - x2, 2) + pow(points[i + 1].y - y2, 2), 'i': i}), lambda s: s.d < 1e-5::DOUBLE * 1e-5::DOUBLE)).i AS b FROM ex JOIN ge USING (way)), "
    "be AS (SELECT link_id, arg_min(CASE WHEN a < b THEN points[a + 1:b + 1] ELSE list_reverse(points[b + 1:a + 1]) END, rank) AS cut FROM tr WHERE a <> b GROUP BY link_id) "
)


@query("join_way_geometry", _SHAPE + "SELECT link_id, cut IS NOT NULL AS snapped, array_to_string(list_transform(coalesce(cut, [{'x': x1, 'y': y1}, {'x': x2, 'y': y2}]), lambda p: printf('%.6f %.6f', p.x, p.y)), ', ') AS points FROM li LEFT JOIN be USING (link_id)")
def join_way_geometry(spark, sf_dir):
    vertices = _vertices(spark, sf_dir)
    every = ways.geometries(vertices, vertices)
    ends = every.selectExpr("way", "points[0].x AS ax", "points[0].y AS ay", "element_at(points, -1).x AS zx", "element_at(points, -1).y AS zy")
    links = ends.selectExpr(*(x.format(off=_OFF) for x in _LINK), "array(way + 1, way) AS ways")
    found = ways.shapes(links, ways.geometries(vertices, links.select(F.explode("ways").alias("way"))))
    return found.select("link_id", "snapped", F.array_join(F.transform("points", lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ", ").alias("points"))


@query("src_osm_ways", _WAYS.split(", fq AS")[0].rstrip() + " SELECT way, count(*) AS n, round(sum(x), 6) AS x, round(sum(y), 6) AS y FROM vx WHERE way % 3 <> 0 GROUP BY way HAVING count(*) > 1")
def src_osm_ways(spark, sf_dir):
    # the cache of geometries: a file of vertices, read for the ways that a network names
    path = f"{shared_dir(spark)}/ways-{uuid.uuid4().hex}"
    _vertices(spark, sf_dir).write.json(path)
    read = spark.read.schema("way long, pos long, node long, x double, y double").json(path)
    wanted = views.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("way"))
    total = lambda c: numbers.rounded(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c]), 6).alias(c)
    return ways.geometries(read, wanted).select("way", F.size("points").cast("long").alias("n"), total("x"), total("y"))
