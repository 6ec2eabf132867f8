"""Routing visits the nodes about both ends of a trip, not the whole network for each origin."""

import random

from corridor.operators import network


def test_a_search_visits_few_nodes(spark, monkeypatch):
    rnd = random.Random(5)
    n, rows = 500, []
    for i in range(5 * n):
        rows.append((f"l{i}", i, f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", 1.0))
    links = spark.createDataFrame(rows, "link_id string, link_pos long, from_node string, to_node string, length double")
    trips = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 3) % n}") for i in range(0, n, 10)], "origin string, destination string")
    visits, write = [], network.materialise

    def counted(df, label):
        out = write(df, label)
        if label == "frontier":
            visits.append(out.count())
        return out

    monkeypatch.setattr(network, "materialise", counted)
    whole = sorted(map(tuple, network.paths(links, trips).collect()), key=str)
    assert sum(visits) < 50 * n / 2
    # a search in halves of its origins, down to one origin each, finds the same
    few = trips.limit(4)
    halved = sorted(map(tuple, network.paths(links, few, 2).collect()), key=str)
    assert halved == [r for r in whole if r in halved] and len(halved) == 4
