"""Routing over roads: a run of nodes with one way in and one way out takes one step of a search."""

import random

from corridor.operators import network
from tests.test_operators import _restricted, _search

_LINKS = "link_id string, link_pos long, from_node string, to_node string, length double"


def test_roads_take_few_levels_and_all_pairs_have_their_paths(spark, monkeypatch):
    rnd, pairs = random.Random(4), []
    for a, b in ((0, 1), (0, 2), (1, 0), (1, 2), (2, 1)):  # roads of 30 nodes between three towns
        road = [f"t{a}", *(f"r{a}{b}_{i}" for i in range(30)), f"t{b}"]
        pairs += zip(road, road[1:])
    pairs += [(f"ring{i}", f"ring{(i + 1) % 5}") for i in range(5)]
    rows = sorted((p, f"l{p}", a, b) for p, (a, b) in zip(rnd.sample(range(500), len(pairs)), pairs))
    links = spark.createDataFrame([(i, p, a, b, 1.0) for p, i, a, b in rows], _LINKS)
    trips = [("t0", "t2"), ("t2", "t0"), ("r01_3", "r01_9"), ("r01_9", "r01_3"), ("r02_5", "r21_20"), ("t1", "r12_0"), ("r10_29", "t0"), ("r10_4", "ring1"), ("ring1", "ring0"), ("t0", "r21_7")]
    widths, write = [], network.materialise

    def counted(df, label):
        out = write(df, label)
        widths.append(label == "frontier")
        return out

    monkeypatch.setattr(network, "materialise", counted)
    found = {(r["origin"], r["destination"]): r["path"] for r in network.paths(links, spark.createDataFrame(trips, "origin string, destination string")).collect()}
    own = [(p, a, b) for p, _, a, b in rows]
    assert found == {(a, b): _search(own, a, b) for a, b in trips}
    assert sum(widths) < 20
    hops = {(r["origin"], r["destination"]): r["hops"] for r in network.hop_counts(links, spark.createDataFrame(trips, "origin string, destination string")).collect()}
    assert hops == {k: path and len(path) - 1 for k, path in found.items()}


def test_small_networks_with_runs(spark):
    rnd = random.Random(8)
    rows, trips, moves = [], [], set()
    for k in range(16):
        nodes = [f"{k}n{i}" for i in range(8)]
        own = []
        for _ in range(9 + k % 5):
            i = len(rows)
            own.append((i, f"l{i}", rnd.choice(nodes), rnd.choice(nodes)))
            rows.append(own[-1])
        moves |= {(b, i, j) for _, i, _, b in own for _, j, a, _ in own if a == b and rnd.random() < 0.3}
        trips += [(a, b) for a in nodes for b in nodes]
    links = spark.createDataFrame([(i, p, a, b, 1.0) for p, i, a, b in rows], _LINKS)
    asked = spark.createDataFrame(trips, "origin string, destination string")
    near = lambda a: [r for r in rows if r[2].split("n")[0] == a.split("n")[0]]
    plain = {(a, b): _search([(p, x, y) for p, _, x, y in near(a)], a, b) for a, b in trips}
    found = {(r["origin"], r["destination"]): r["path"] for r in network.paths(links, asked).collect()}
    assert found == plain
    forbidden = spark.createDataFrame(sorted(moves), "via_node string, from_link string, to_link string")
    found = {(r["origin"], r["destination"]): r["path"] for r in network.restricted_paths(links, asked, forbidden).collect()}
    assert found == {(a, b): _restricted(near(a), a, b, moves) for a, b in trips}
