"""Ways of a map: cut into a network's links where they meet, and cut to the shape of a link.

A way is rows of vertices (``way, pos, node, x, y``: longitude and latitude).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.functions import roads
from corridor.functions.geo import haversine_km
from corridor.operators.ranges import dense
from corridor.session import materialise

#: Fixed value: how near, in degrees, a vertex must be to an end of a link.
SNAP = 1e-5


def cuts(vertices: DataFrame, tags: DataFrame) -> DataFrame:
    """``way, pos, node, x, y, upto, beside, times``: the vertices where a way begins, ends or meets a way (itself too), written once.

    ``upto`` is the length of the way so far, in m, ``beside`` the number of its parts that end
    here, and ``times`` how many links each part makes. Rows come by ways and stay so: only the vertices that are shared are looked up.
    """
    shared = materialise(vertices.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(True).alias("_shared")), "shared")
    along = W.partitionBy("way").orderBy("pos")  # a way's vertices
    rows = vertices.where("node IS NOT NULL").join(shared, "node", "left").withColumns({"_x": F.lag("x").over(along), "_y": F.lag("y").over(along), "_last": F.lead("node").over(along).isNull()})
    step = F.coalesce(haversine_km(F.col("_y"), F.col("_x"), F.col("y"), F.col("x")) * 1000, F.lit(0.0))
    rows = rows.withColumn("upto", F.sum(step).over(along)).where("_shared OR _x IS NULL OR _last")
    beside = F.lag("node").over(along).isNotNull().cast("int") + F.lead("node").over(along).isNotNull().cast("int")
    times = tags.groupBy("way").agg(F.sum(F.when(~F.col("oneway"), 2).otherwise(1)).alias("times"))
    return materialise(rows.withColumn("beside", beside).join(times, "way", "left").select("way", "pos", "node", "x", "y", "upto", "beside", "times"), "cuts")


def nodes_of(cut: DataFrame, signals: DataFrame) -> DataFrame:
    """Nodes at the ends of links, numbered by their vertex; ``signals`` are vertices (``node``) with one."""
    ends = cut.groupBy("node").agg(F.sum(F.col("beside") * F.coalesce("times", F.lit(0))).alias("degree"), F.min(F.struct("x", "y")).alias("p")).where("degree > 0")
    lit = signals.select("node").distinct().withColumn("lit", F.lit(True))
    nodes = dense(ends.join(lit, "node", "left").select("node", "p.x", "p.y", roads.node_type(F.col("degree")).alias("type"), F.coalesce("lit", F.lit(False)).alias("has_signal")), ["node"], "k")
    return nodes.select(F.concat(F.lit("n"), "k").alias("id"), F.col("node").alias("osm_id"), "x", "y", "type", "has_signal", "k")


def links_of(cut: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """``id, link_pos, from_node, to_node, length_m, osm_way_id`` and what else ``tags`` have: links numbered by ends, way and place.

    The numbers of nodes rise with their vertices, so they stand for them in the order.
    """
    along = W.partitionBy("way").orderBy("pos")
    rows = cut.select("way", "pos", "node", "upto").join(nodes.select(F.col("osm_id").alias("node"), F.col("k").alias("u")), "node").drop("node")
    ahead = rows.withColumns({"v": F.lead("u").over(along), "_end": F.lead("upto").over(along)}).where("v IS NOT NULL").withColumn("length_m", F.col("_end") - F.col("upto"))
    own = [c for c in tags.columns if c not in ("way", "oneway")]
    link = lambda a, b, back: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(back).alias("back"))
    both = F.when(~F.col("oneway"), F.array(link("u", "v", 0), link("v", "u", 1))).otherwise(F.array(link("u", "v", 0)))
    real = ahead.where("u <> v AND length_m > 0").join(tags, "way").select("way", "pos", "length_m", *own, F.explode(both).alias("_link")).select("_link.*", "way", "pos", "length_m", *own)
    placed = dense(real, ["u", "v", "way", "pos", "back"], "k")
    named = lambda c, name: F.concat(F.lit("n"), c).alias(name)
    return placed.select(F.concat(F.lit("l"), "k").alias("id"), F.col("k").alias("link_pos"), named("u", "from_node"), named("v", "to_node"), "length_m", F.col("way").alias("osm_way_id"), *own)


def attributes(tags: DataFrame) -> DataFrame:
    """``way, oneway, lanes, speed_mps, highway, name`` of the ways' ``tags``, read once a way."""
    classed = tags.withColumn("class", roads.pick_class(F.col("highway")))
    return classed.select("way", "oneway", roads.lanes(F.col("lanes"), F.col("class")).alias("lanes"), roads.speed_mps(F.col("maxspeed"), F.col("class")).alias("speed_mps"), F.col("class").alias("highway"), "name")


def network(vertices: DataFrame, tags: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the ways (``tags``: ``way, highway`` (several), ``maxspeed, lanes, name, oneway``); ``signals`` are vertices (``node``) with one.

    Nodes are numbered by their vertex, links by ends, way and place. A link goes back where the way
    is not one-way; links from a node to itself and those without a length are left out, though
    they count for a node's type.
    """
    cut = cuts(vertices, tags)
    nodes = nodes_of(cut, signals)
    links = links_of(cut, nodes, attributes(tags))
    return nodes.drop("k"), links.select("id", "link_pos", "from_node", "to_node", "length_m", "lanes", "speed_mps", "highway", "osm_way_id", "name")


def restrictions(relations: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``type, from_link, via_node, to_link`` of relations (``type, from_way, via, to_way``) whose ways reach and leave their vertex: by the first link of each."""
    first = lambda end, way, name: links.groupBy(F.col("osm_way_id").alias(way), F.col(end).alias("via_node")).agg(F.min_by("id", "link_pos").alias(name))
    via = relations.join(nodes.select(F.col("osm_id").alias("via"), F.col("id").alias("via_node")), "via")
    return via.join(first("to_node", "from_way", "from_link"), ["from_way", "via_node"]).join(first("from_node", "to_way", "to_link"), ["to_way", "via_node"]).select("type", "from_link", "via_node", "to_link")


def geometries(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """``way, points`` of the wanted ways with two vertices or more, in order."""
    own = vertices.join(wanted.select("way").distinct(), "way", "left_semi").where("x IS NOT NULL AND y IS NOT NULL")
    by = own.groupBy("way").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))  # a way's vertices
    return by.where("size(p) > 1").select("way", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))


def _nearest(points: str, x: str, y: str) -> Column:
    """Place of the vertex nearest to a point, from 0; null where none is within ``SNAP``."""
    off = F.transform(points, lambda p, i: F.struct((F.pow(p["x"] - F.col(x), F.lit(2.0)) + F.pow(p["y"] - F.col(y), F.lit(2.0))).alias("d"), i.alias("i")))
    return F.array_min(F.filter(off, lambda s: s["d"] < SNAP * SNAP))["i"]


def shapes(links: DataFrame, ways: DataFrame) -> DataFrame:
    """``link_id, points, snapped``: each link (``x1, y1, x2, y2, known, ways``) along the first of its ways that has vertices at both ends, else straight.

    ``known`` tells whether both ends are vertices of the map; a way against the link is turned.
    """
    tried = links.where("known").select("link_id", "x1", "y1", "x2", "y2", F.posexplode("ways").alias("rank", "way")).join(ways, "way")
    tried = tried.withColumns({"a": _nearest("points", "x1", "y1"), "b": _nearest("points", "x2", "y2")}).where("a <> b")
    cut = F.when(F.col("a") < F.col("b"), F.slice("points", F.col("a") + 1, F.col("b") - F.col("a") + 1)).otherwise(F.reverse(F.slice("points", F.col("b") + 1, F.col("a") - F.col("b") + 1)))
    best = tried.groupBy("link_id").agg(F.min_by(cut, "rank").alias("cut"))
    straight = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return links.join(best, "link_id", "left").select("link_id", F.coalesce("cut", straight).alias("points"), F.col("cut").isNotNull().alias("snapped"))
