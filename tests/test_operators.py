"""Operators on hand-computed cases."""

import math
import random
from collections import deque

from corridor import registry, views
from corridor.operators import demand, events, fidelity, network, statistics


def test_floor_percentile(spark):
    rows = spark.createDataFrame([(x,) for x in (10.0, 20.0, 30.0, 40.0, 50.0)], "v double")
    assert statistics.floor_percentile(rows, [], "v").first()["p"] == 40.0
    assert statistics.floor_percentile(rows, [], "v", of_n=True).first()["p"] == 50.0
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 0)], "v double, w long")
    assert tuple(statistics.floor_percentile(weighted, [], "v", weight="w").first()) == (4, 1.0)
    assert statistics.floor_percentile(rows.limit(0), [], "v").count() == 0


def test_cell_stats(spark):
    rows = [("c", "e", m, s, "success", 1.0, tt, tt, 5) for m, s, tt in (("meso", 1, 204.1), ("meso", 2, 204.0), ("micro", 1, 287.0), ("micro", 2, 287.5))]
    rows.append(("c", "f", "meso", 1, "failed", 1.0, 3.0, 3.0, 5))
    runs = spark.createDataFrame(rows, "scenario string, engine string, mode string, seed long, status string, runtime_s double, tt_mean double, tt_p95 double, trip_count long")
    found = {(r["engine"], r["mode"]): r for r in statistics.cell_stats(runs).collect()}
    assert abs(found["e", "meso"]["mean_tt"] - 204.05) < 1e-9 and found["e", "micro"]["r"] > 0.99
    assert found["f", "meso"]["successes"] == 0 and found["f", "meso"]["mean_tt"] == 0.0


def test_reproducibility(spark):
    rows = [("one", 42.0), *[("same", 10.0)] * 3, *[("zero", 0.0)] * 3, ("far", 0.0), ("far", 200.0)]
    found = {r["k"]: r["r"] for r in statistics.reproducibility_index(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert found == {"same": 1.0, "zero": 1.0, "far": 0.0}


def test_fidelity(spark):
    pairs = spark.createDataFrame([(10, 12), (20, 18), (30, 32), (40, 38)], "a long, b long")
    assert fidelity.rmse(pairs, "a", "b").first()["rmse"] == 2.0
    counts = spark.createDataFrame([("x", 1, 100), ("y", 1, 105), ("x", 2, 100), ("y", 2, 200)], "e string, k int, n long")
    assert fidelity.geh_batch(counts, "k", "e", "n", "x", "y").first()["below_5_pct"] == 50.0
    lone = fidelity.geh_batch(counts.where("e = 'x'"), "k", "e", "n", "x", "y").first()
    assert math.isinf(lone["mean_geh"]) and lone["below_5_pct"] == 0.0
    values = spark.createDataFrame([("x", v) for v in (1, 2, 3)] + [("y", v) for v in (10, 11, 12)] + [("z", v) for v in (1, 2, 3)], "e string, v long")
    assert fidelity.ks(values, "e", "v", "x", "y").first()["d"] == 1.0
    assert fidelity.ks(values, "e", "v", "x", "z").first()["d"] == 0.0


def test_demand(spark):
    names = ["HBW_AM", "HBW_AM", "HBSchool_AM", "HBW_AM_chained", "HBW_PM", "HBW_PM_chained", "HBSchool_PM", " ", None]
    rows = spark.createDataFrame([(p,) for p in names], "purpose string")
    assert tuple(demand.composition(rows).first()) == (7, 4, 3, 4, 1, 1)
    trips = spark.createDataFrame(
        [("1", "a", "c", "car", 0), ("2", "a", "d", "car", 5), ("3", None, "a", "car", 9), ("4", "a", "c", "walk", 1), ("5", "a", "x", "car", 2), ("6", "a", "b", " ", 4000)],
        "trip_id string, origin string, destination string, mode string, departure_time_s long",
    )
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    found = demand.classify(trips, nodes, nodes.where("node <> 'd'"), ("car",))
    assert [r["reason"] for r in found.orderBy("trip_id").collect()] == ["feasible", "outside_scc", "missing_fields", "unsupported_mode", "unknown_node", "feasible"]
    dense = {r["trip_id"]: r["dense_id"] for r in demand.dense_ids(trips).collect()}
    assert dense == {"1": "t0", "4": "t1", "5": "t2", "2": "t3", "3": "t4", "6": "t5"}


def _links(spark, pairs):
    return spark.createDataFrame([(f"l{i}", i, a, b, 1.0) for i, (a, b) in enumerate(pairs)], "link_id string, link_pos long, from_node string, to_node string, length double")


def test_network(spark):
    cormen = ["12", "23", "31", "34", "45", "54", "67", "78", "86", "46"]
    assert {r["node"] for r in network.largest_component(_links(spark, [tuple(p) for p in cormen])).collect()} == {"1", "2", "3"}
    assert {r["node"] for r in network.largest_component(_links(spark, [("a", "b"), ("b", "c")])).collect()} == {"a"}
    links = _links(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    hops = {r["node"]: r["hops"] for r in network.hops(links, spark.createDataFrame([("a",)], "node string")).collect()}
    assert hops == {"a": 0, "b": 1, "c": 1, "d": 2}
    rules = spark.createDataFrame([("no_left", "l0", "b", "l1"), ("only_left", "l9", "a", "l0")], "type string, from_link string, via_node string, to_link string")
    assert {tuple(r) for r in network.forbidden_moves(rules, links).collect()} == {("b", "l0", "l1"), ("a", "l9", "l2")}


def test_events(spark):
    rows = [(1, 7, "entered", 0, 1), (1, 7, "entered", 5, 2), (1, 7, "left", 9, 3), (1, 7, "left", 11, 4), (2, 7, "left", 3, 5)]
    found = events.visits(spark.createDataFrame(rows, "veh long, link long, type string, t long, pos long"))
    assert [tuple(r) for r in found.collect()] == [(1, 7, 5, 9)]
    frames = spark.createDataFrame([(5,), (8,), (20,)], "t long")
    assert {tuple(r) for r in events.active_at(found, frames, 4).collect()} == {(5, 1), (8, 1)}


def _search(links, origin, dest):
    """A breadth-first search over ``(link_pos, from, to)`` in order."""
    if origin is None or dest is None:
        return None
    parent, queue = {origin: None}, deque([origin])
    while queue:
        node = queue.popleft()
        if node == dest:
            path = [node]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            return path[::-1]
        for _, a, b in links:
            if a == node and b not in parent:
                parent[b] = node
                queue.append(b)
    return None


def test_paths(spark):
    rnd = random.Random(3)
    nodes = [f"n{i}" for i in range(9)]
    for visited in (50, 1000):
        pairs = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(22)]
        order = rnd.sample(range(100), len(pairs))
        rows = [(f"l{i}", p, a, b, 1.0) for i, (p, (a, b)) in enumerate(zip(order, pairs))]
        links = spark.createDataFrame(rows, "link_id string, link_pos long, from_node string, to_node string, length double")
        ends = [(a, b) for a in [*nodes, "far", None] for b in [*nodes, "far", None]]
        trips = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*ends, *ends[:5]])], "trip_id long, origin string, destination string")
        own = sorted((p, a, b) for _, p, a, b, _ in rows)
        found = {r["trip_id"]: r["path"] for r in network.paths(links, trips, visited).collect()}
        assert found == {i: _search(own, a, b) for i, (a, b) in enumerate([*ends, *ends[:5]])}
    long = _links(spark, [(f"v{i}", f"v{i + 1}") for i in range(19)])
    trips = spark.createDataFrame([("v0", "v19"), ("v19", "v0")], "origin string, destination string")
    assert {r["origin"]: r["path"] for r in network.paths(long, trips).collect()} == {"v0": [f"v{i}" for i in range(20)], "v19": None}


def test_every_trip_has_its_path(spark):
    sf = "/root/testdata/sf0.001"
    links = sorted(tuple(r) for r in views.links(spark, sf).select("link_pos", "from_node", "to_node").collect())
    trips = views.trips(spark, sf).collect()
    found = {r["trip_id"]: r["path"] for r in registry.queries()["gr_bfs_paths"](spark, sf).collect()}
    paths = {r["trip_id"]: _search(links, r["origin"], r["destination"]) for r in trips}
    assert found == {k: p if p is None else " ".join(p) for k, p in paths.items()}


def _restricted(links, origin, dest, forbidden):
    """A breadth-first search over states of node and last link; ``links`` are (pos, id, from, to) in order."""
    if origin is None or dest is None:
        return None
    if origin == dest:
        return [origin]
    last = {(a, b): i for _, i, a, b in links}
    queue, parent = deque([(origin, None)]), {(origin, None): None}
    while queue:
        state = queue.popleft()
        for _, _, a, b in links:
            if a != state[0] or (a, state[1], last[a, b]) in forbidden or (b, last[a, b]) in parent:
                continue
            parent[b, last[a, b]] = state
            if b == dest:
                path, at = [], (b, last[a, b])
                while at is not None:
                    path.append(at[0])
                    at = parent[at]
                return path[::-1]
            queue.append((b, last[a, b]))
    return None


def test_restricted_paths(spark):
    rnd = random.Random(11)
    nodes = [f"n{i}" for i in range(7)]
    rows = [(f"l{i}", i, rnd.choice(nodes), rnd.choice(nodes), 1.0) for i in range(20)]
    links = spark.createDataFrame(rows, "link_id string, link_pos long, from_node string, to_node string, length double")
    moves = {(b, i, j) for i, _, _, b, _ in rows for j, _, a, _, _ in rows if a == b and rnd.random() < 0.4}
    forbidden = spark.createDataFrame(sorted(moves), "via_node string, from_link string, to_link string")
    ends = [(a, b) for a in [*nodes, None] for b in [*nodes, "far"]]
    trips = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends)], "trip_id long, origin string, destination string")
    own = [(p, i, a, b) for i, p, a, b, _ in rows]
    found = {r["trip_id"]: r["path"] for r in network.restricted_paths(links, trips, forbidden).collect()}
    assert found == {i: _restricted(own, a, b, moves) for i, (a, b) in enumerate(ends)}
    plain = [(p, a, b) for i, p, a, b, _ in rows]
    found = {r["trip_id"]: r["path"] for r in network.routes(links, trips, forbidden).collect()}
    assert found == {i: _restricted(own, a, b, moves) or _search(plain, a, b) or [] for i, (a, b) in enumerate(ends)}
    fixture = _links(spark, [("n1", "n2"), ("n2", "n3"), ("n2", "n4"), ("n3", "n5"), ("n4", "n5")])
    one = spark.createDataFrame([("n1", "n5")], "origin string, destination string")
    bar = lambda *to: spark.createDataFrame([("n2", "l0", t) for t in to], "via_node string, from_link string, to_link string")
    assert network.restricted_paths(fixture, one, bar("l2")).first()["path"] == ["n1", "n2", "n3", "n5"]
    assert network.restricted_paths(fixture, one, bar("l1")).first()["path"] == ["n1", "n2", "n4", "n5"]
    assert network.restricted_paths(fixture, one, bar("l1", "l2")).first()["path"] is None


def test_ring_and_random_components(spark):
    ring = _links(spark, [(f"v{i}", f"v{(i + 1) % 5000}") for i in range(5000)] + [("v3", "out"), ("in", "v9")])
    assert {r["node"] for r in network.largest_component(ring).collect()} == {f"v{i}" for i in range(5000)}
    rnd = random.Random(6)
    for n, m in ((12, 14), (14, 18), (9, 30)):
        pairs = [(f"x{rnd.randrange(n)}", f"x{rnd.randrange(n)}") for _ in range(m)]
        reach = {a: {a} for p in pairs for a in p}
        for _ in range(n):
            for a, b in pairs:
                for s in reach:
                    if a in reach[s]:
                        reach[s].add(b)
        found = {frozenset(b for b in reach[a] if a in reach[b]) for a in reach if any(a != b for b in reach) or True}
        linked = {a for p in pairs if p[0] != p[1] for a in p}
        best = min((c for c in found if c & linked), key=lambda c: (-len(c), min(c)))
        assert {r["node"] for r in network.largest_component(_links(spark, pairs)).collect()} == set(best)
