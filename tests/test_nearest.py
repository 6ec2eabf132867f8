"""Nearest sites in crowded cells: the same rows, without a pair for each point and site of a cell."""

import random

from corridor.operators import spatial


def test_crowded_cells(spark, monkeypatch):
    rnd = random.Random(2)
    spot = lambda: (40 + rnd.gauss(0, 0.004), -80 + rnd.gauss(0, 0.004))
    points = spark.createDataFrame([*((i, *spot()) for i in range(300)), (7, 40.0, -80.0), (None, 40.0, -80.0)], "id long, lat double, lon double")
    sites = spark.createDataFrame([(i, i // 2, *p) for i, p in enumerate([spot() for _ in range(400)] + [(40.001, -80.001)] * 4)], "id long, pos long, lat double, lon double")
    pairs, nearest = [], spatial._nearest

    def counted(met, *rest):
        pairs.append(met.count())
        return nearest(met, *rest)

    monkeypatch.setattr(spatial, "_nearest", counted)
    found = []
    for crowd in (10**9, 2):  # the first takes the one step of before
        monkeypatch.setattr(spatial, "CROWD", crowd)
        pairs.clear()
        rows = [sorted(map(tuple, f.collect()), key=str) for f in (spatial.nearest_in_grid(points, sites, 0.005, 0.5), spatial.nearest_within(points, sites, 1.5))]
        found.append((rows, sum(pairs)))
    assert found[0][0] == found[1][0] and len(found[0][0][1]) == 301
    assert found[1][1] < found[0][1] / 5
