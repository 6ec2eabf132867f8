"""Strong components by nested blocks against a plain search, and their number of jobs."""

import random

import pytest

from corridor.operators import components, network


def _links(spark, pairs):
    return spark.createDataFrame([(f"l{i}", i, a, b, 1.0) for i, (a, b) in enumerate(pairs)], "link_id string, link_pos long, from_node string, to_node string, length double")


def _plain(pairs):
    """The component of each node by two searches from each, on small networks."""
    ways, back = {}, {}
    for a, b in pairs:
        if a != b:
            ways.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
    reach = lambda edges, node: components._reached(node, edges)
    return {n: min(reach(ways, n) & reach(back, n)) for n in {*ways, *back}}


def _found(spark, pairs, block):
    return {r["node"]: r["component"] for r in components.strong_components(_links(spark, pairs), block).collect()}


@pytest.mark.parametrize("block, seed, n, m", [(10, 1, 40, 55), (components.BLOCK, 1, 40, 55), (components.BLOCK, 2, 60, 200)])
def test_components_of_random_networks(spark, block, seed, n, m):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    near = [(f"n{i}", f"n{(i + rnd.choice((1, 1, 2, -1))) % n}") for i in range(n)]
    pairs = near + [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(m - n)]
    assert _found(spark, pairs, block) == _plain(pairs)


def test_an_order_with_rings(spark):
    back = [(10, 5), (140, 31), (360, 250), (4, 0)]
    chain = [(f"v{i:03}", f"v{i + 1:03}") for i in range(400)] + [(f"v{a:03}", f"v{b:03}") for a, b in back]
    assert _found(spark, chain, 160) == _plain(chain)


def test_search_where_rounds_do_not_shrink(spark, monkeypatch):
    monkeypatch.setattr(components, "SHRINK", -1.0)
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randint(0, 29)}", f"n{rnd.randint(0, 29)}") for _ in range(60)]
    assert _found(spark, pairs, 8) == _plain(pairs)


def test_a_long_network_takes_few_jobs(spark, monkeypatch):
    """A grid of 5,000 by 4 crossings with one-way streets: thousands of hops wide."""
    pairs = []
    for x in range(5_000):
        for y in range(4):
            if x + 1 < 5_000:
                pairs.append((f"{x}.{y}", f"{x + 1}.{y}") if y % 2 == 0 else (f"{x + 1}.{y}", f"{x}.{y}"))
            if y + 1 < 4:
                pairs.append((f"{x}.{y}", f"{x}.{y + 1}") if x % 2 == 0 else (f"{x}.{y + 1}", f"{x}.{y}"))
    written, plain = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: written.append(label) or plain(df, label))
    found = network.largest_component(_links(spark, pairs))
    ways, back = components._ways(pairs), components._ways((b, a) for a, b in pairs)
    seed = "2500.0"
    assert {r["node"] for r in found.collect()} == components._reached(seed, ways) & components._reached(seed, back)
    assert len(written) <= 40


def test_a_network_without_neighbourhood_takes_few_jobs(spark, monkeypatch):
    """Random links: no cut keeps them within blocks."""
    rnd = random.Random(9)
    pairs = [(f"n{rnd.randrange(1_500)}", f"n{rnd.randrange(1_500)}") for _ in range(9_000)] + [("n3", "x1"), ("x1", "x2"), ("x2", "x1"), ("y1", "y2"), ("y2", "y1")]
    written, plain = [], components.materialise
    for module in (components, network):
        monkeypatch.setattr(module, "materialise", lambda df, label: written.append(label) or plain(df, label))
    assert _found(spark, pairs, 64) == _plain(pairs)
    assert len(written) <= 20, len(written)


def test_long_ways_between_hubs_take_few_jobs(spark, monkeypatch):
    """Nodes of many ways, a one-way road of many nodes between any two of them: a search would take a job a hop."""
    rnd, pairs = random.Random(4), [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("h3", "y0"), ("y0", "y1"), ("y1", "y2"), ("y2", "y0"), ("y1", "y3")]
    for hub in range(20):
        road = [f"h{hub}", *(f"r{hub}.{i}" for i in range(50)), f"e{hub}"]
        pairs += list(zip(road, road[1:])) + [(f"e{hub}", f"h{rnd.randrange(20)}") for _ in range(6)]
    pairs += [("z", "z1"), ("z1", "z2"), ("z2", "z"), ("z", "z3"), ("z3", "z"), ("z", "h0")]  # z has runs alone, back to itself
    written, plain = [], components.materialise
    for module in (components, network):
        monkeypatch.setattr(module, "materialise", lambda df, label: written.append(label) or plain(df, label))
    assert _found(spark, pairs, 64) == _plain(pairs)
    assert len(written) <= 45, len(written)


def test_rings_alone_end(spark):
    """Every node has one way in and one way out, so none ends a run."""
    pairs = [e for i in range(8) for e in ((f"a{i}", f"b{i}"), (f"b{i}", f"a{i}"), (f"c{i}", f"c{(i + 1) % 8}"))]
    assert _found(spark, pairs, 4) == _plain(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_random_networks_with_runs(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for _ in range(16)]
    for i in range(10):
        road = [f"n{rnd.randrange(12)}", *(f"m{i}.{j}" for j in range(rnd.randint(1, 9))), f"n{rnd.randrange(12)}"]
        pairs += list(zip(road, road[1:]))
    assert _found(spark, pairs, 8) == _plain(pairs)


def _rounds(edges, rnd):
    """The rounds over the block functions alone, with any cut into blocks."""
    nodes = sorted({x for e in edges for x in e})
    if len(nodes) <= 6:
        return {x: min(own) for own in components._searched_block(nodes, components._ways(edges)) for x in own}
    n = max(2, len(nodes) // 5)
    block = {x: i * n // len(nodes) if rnd.random() < 0.9 else rnd.randrange(n) for i, x in enumerate(nodes)}
    cross = [e for e in edges if block[e[0]] != block[e[1]]]
    made = {}
    for b in set(block.values()):
        rows = [("e", *e) for e in edges if block[e[0]] == b == block[e[1]]] + [("t", x, None) for x in {x for e in cross for x in e if block[x] == b}]
        if rows:
            made[b] = components._up(components._table(str(b), rows)).to_pylist()
    home = {r["x"]: r["y"] for m in made.values() for r in m if r["kind"] == "m"}
    graph = {(home[a], home[c]) for a, c in cross} | {(r["x"], r["y"]) for m in made.values() for r in m if r["kind"] == "n"}
    both = {a for a, _ in graph} & {b for _, b in graph}
    rest = sorted(e for e in graph if e[0] in both and e[1] in both and e[0] != e[1])
    above = _rounds(rest, rnd) if rest and len({x for e in rest for x in e}) < len(nodes) else {x: own for x, own in _plain(rest).items()}
    out = {}
    for b, m in made.items():
        rows = [(r["kind"], r["x"], r["y"]) for r in m if r["kind"] != "n"] + [("l", h, above[h]) for h in {r["y"] for r in m if r["kind"] == "m"} & set(above)]
        found = {r["x"]: r["y"] for r in components._down(components._table(str(b), rows)).to_pylist()}
        out.update({x: found[h] for x, h in home.items() if block[x] == b})
    return out


def test_any_cut_is_right():
    for seed in range(800):
        rnd = random.Random(seed)
        n = rnd.randint(4, 60)
        names = [f"v{i:03}" for i in range(n)]
        line = {(names[i], names[i + 1]) for i in range(n - 1)} | {tuple(sorted((rnd.choice(names), rnd.choice(names)), reverse=True)) for _ in range(rnd.randint(0, 6))}
        loose = {(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randint(3, 3 * n))}
        pairs = sorted(e for e in (line if seed % 2 else loose) if e[0] != e[1])
        found = _rounds(pairs, rnd)
        least = {}
        for node, label in found.items():
            least[label] = min(node, least.get(label, node))
        assert {node: least[label] for node, label in found.items()} == _plain(pairs)
