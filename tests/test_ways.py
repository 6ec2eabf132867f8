"""Ways cut into links and into shapes, by hand-computed cases."""

from pyspark.sql import functions as F

from corridor.operators import ranges, ways

VERTEX = "way long, pos long, node long, x double, y double"
#: Two ways that cross at 3, one of them closed at its end; 6 lies on 5.
ROWS = [
    (1, 1, 1, 0.0, 0.0), (1, 2, 2, 0.001, 0.0), (1, 3, 3, 0.002, 0.0), (1, 4, 4, 0.003, 0.0),
    (2, 1, 5, 0.002, 0.001), (2, 2, 3, 0.002, 0.0), (2, 3, 7, 0.003, -0.001), (2, 4, 3, 0.002, 0.0),
    (3, 1, 5, 0.002, 0.001), (3, 2, 6, 0.002, 0.001),
]
TAGS = [(1, ["primary"], "36", "2", "a", True), (2, ["service", "residential"], None, None, None, False), (3, ["residential"], None, None, None, False)]


def _network(spark):
    vertices = spark.createDataFrame(ROWS, VERTEX).repartition(3)
    tags = spark.createDataFrame(TAGS, "way long, highway array<string>, maxspeed string, lanes string, name string, oneway boolean")
    return ways.network(vertices, tags, vertices.where("node IN (3, 2)").select("node"))


def test_network(spark):
    nodes, links = _network(spark)
    assert [(r["id"], r["osm_id"], r["has_signal"]) for r in nodes.orderBy("osm_id").collect()] == [("n0", 1, False), ("n1", 3, True), ("n2", 4, False), ("n3", 5, False), ("n4", 6, False)]
    found = [(r["id"], r["from_node"], r["to_node"], r["osm_way_id"], r["lanes"], r["highway"]) for r in links.orderBy("link_pos").collect()]
    # 3 - 7 - 3 is a loop and 5 - 6 has no length
    assert found == [("l0", "n0", "n1", 1, 2, "primary"), ("l1", "n1", "n2", 1, 2, "primary"), ("l2", "n1", "n3", 2, 1, "residential"), ("l3", "n3", "n1", 2, 1, "residential")]
    metres = {r["id"]: r["length_m"] for r in links.collect()}
    assert abs(metres["l0"] - 222.39) < 0.01 and abs(metres["l2"] - 111.19) < 0.01
    assert links.where("osm_way_id = 1").first()["speed_mps"] == 10.0


def test_restrictions(spark):
    nodes, links = _network(spark)
    relations = spark.createDataFrame([("no_left_turn", 1, 3, 2), ("no_u_turn", 2, 3, 1), ("no_entry", 1, 2, 2), ("no_exit", 3, 5, 2)], "type string, from_way long, via long, to_way long")
    assert {tuple(r) for r in ways.restrictions(relations, nodes, links).collect()} == {("no_left_turn", "l0", "n1", "l2"), ("no_u_turn", "l3", "n1", "l1")}


def test_shapes(spark):
    vertices = spark.createDataFrame(ROWS, VERTEX)
    links = [
        ("ahead", 0.0, 0.0, 0.002, 0.0, True, [9, 1]), ("back", 0.003, 0.0, 0.001, 0.0, True, [1]), ("near", 0.0, 0.000009, 0.001, 0.0, True, [1]), ("far", 0.0, 0.00002, 0.001, 0.0, True, [1]),
        ("unknown", 0.0, 0.0, 0.002, 0.0, False, [1]), ("point", 0.0, 0.0, 0.0, 0.0, True, [1]), ("second", 0.002, 0.001, 0.003, -0.001, True, [1, 2]), ("none", 0.0, 0.0, 1.0, 1.0, True, []),
    ]
    frame = spark.createDataFrame(links, "link_id string, x1 double, y1 double, x2 double, y2 double, known boolean, ways array<long>")
    found = {r["link_id"]: ([tuple(p) for p in r["points"]], r["snapped"]) for r in ways.shapes(frame, ways.geometries(vertices, vertices)).collect()}
    straight = {k: [(a, b), (c, d)] for k, a, b, c, d, *_ in links}
    assert found["ahead"] == ([(0.0, 0.0), (0.001, 0.0), (0.002, 0.0)], True)
    assert found["back"] == ([(0.003, 0.0), (0.002, 0.0), (0.001, 0.0)], True)
    assert found["near"] == ([(0.0, 0.0), (0.001, 0.0)], True)
    assert found["second"] == ([(0.002, 0.001), (0.002, 0.0), (0.003, -0.001)], True)
    assert all(found[k] == (straight[k], False) for k in ("far", "unknown", "point", "none"))


def test_a_network_places_its_vertices_once(spark, monkeypatch):
    """Nodes and links read the cuts, not the vertices; nodes need no links."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(w, p, w * 10 + p if p else 5, w * 0.01 + p * 0.001, 40.0 + p * 0.002) for w in range(1, 9) for p in range(5)]
    plain = spark.createDataFrame(rows, "way long, pos long, node long, x double, y double")
    vertices = plain.withColumn("x", F.udf(lambda x: seen.add(1) or x, "double")("x"))
    tags = spark.createDataFrame([(w, ["residential"], None, None, "a", w % 2 == 0) for w in range(1, 9)], "way long, highway array<string>, maxspeed string, lanes string, name string, oneway boolean")
    written, kept = [], ways.materialise
    for module in (ways, ranges):
        monkeypatch.setattr(module, "materialise", lambda df, label: written.append(label) or kept(df, label))
    nodes, links = ways.network(vertices, tags, plain.where("node = 5").select("node"))
    assert (nodes.count(), links.count()) == (9, 12)
    assert seen.value == len(rows)
    written.clear()
    assert ways.nodes_of(ways.cuts(plain, tags), plain.select("node")).count() == 9
    assert written == ["shared", "cuts", "dense"]
