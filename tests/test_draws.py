"""Draws by mass and distance against the plain weights, and trips that are all made."""

import math
import random

import pytest

from corridor.operators import draws, generate

KINDS = "node string, idx long, degree long, lat double, lon double"


def _km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(min(1.0, x)))


def _nodes(n, spread=0.2):
    rnd = random.Random(n)
    rows = [(f"n{i}", i * 3, rnd.randint(0, 9), 40 + rnd.random() * spread, -80 + rnd.random() * spread) for i in range(n - 6)]
    return rows + [(f"n{i}", i * 3, 4, 40.05, -79.95) for i in range(n - 6, n)]  # some on one spot


def _gravity(nodes, origin):
    total = sum(r[2] for r in nodes)
    at = {r[0]: r[3:] for r in nodes}
    out = {}
    for name, _, degree, *place in nodes:
        km = _km(at[origin], place)
        out[name] = 0 if name == origin else (degree + 1) / total / (km + 0.1) if 0.5 <= km <= 10 else 0.01
    return out


def _bell(nodes, origin, minutes):
    goal = max(0.5, min(15.0, minutes * 0.5))
    at = {r[0]: r[3:] for r in nodes}
    out = {}
    for name, _, degree, *place in nodes:
        km = _km(at[origin], place)
        out[name] = 0 if name == origin or km < 0.1 else (degree + 1) * math.exp(-0.5 * ((km - goal) / (goal * 0.7 + 0.5)) ** 2)
    return out


def _chi_square(counts, weights):
    """Of counts by name against weights, in standard deviations of the statistic; names of little weight go together."""
    n, total = sum(counts.values()), sum(weights.values())
    assert all(weights[name] > 0 for name in counts)
    rest_seen = rest_due = stat = 0.0
    k = -1
    for name, w in weights.items():
        due, seen = n * w / total, counts.get(name, 0)
        if due < 8:
            rest_due, rest_seen = rest_due + due, rest_seen + seen
        else:
            stat, k = stat + (seen - due) ** 2 / due, k + 1
    if rest_due >= 8:
        stat, k = stat + (rest_seen - rest_due) ** 2 / rest_due, k + 1
    return (stat - k) / math.sqrt(2 * k)


def _counted(rows):
    out = {}
    for r in rows:
        own = out.setdefault(r["origin"], {})
        own[r["destination"]] = own.get(r["destination"], 0) + 1
    return out


@pytest.mark.parametrize("leaf, patience", [(32, draws.PATIENCE), (2, draws.PATIENCE), (2, 4)])
def test_bell_draws_follow_the_weights(spark, monkeypatch, leaf, patience):
    nodes = _nodes(120)
    people = [(k, ("n3", "n60", "n117")[k % 3], (4, 20, 70)[k % 3]) for k in range(9_000)]
    plain = draws.draw
    monkeypatch.setattr(generate, "draw", lambda rows, places, parts, seed: plain(rows, places, parts, seed, leaf, patience))
    found = generate.gaussian_pairs(spark.createDataFrame(people, "k long, home string, commute_min int"), spark.createDataFrame(nodes, KINDS), 7).collect()
    assert sorted(r["k"] for r in found) == list(range(9_000))
    counts = _counted(found)
    for origin, minutes in (("n3", 4), ("n60", 20), ("n117", 70)):
        assert _chi_square(counts[origin], _bell(nodes, origin, minutes)) < 4


def test_gravity_draws_follow_the_weights(spark):
    nodes = _nodes(90)
    found = generate.gravity_pairs(spark.range(30_000).withColumnRenamed("id", "k"), spark.createDataFrame(nodes, KINDS), 3).collect()
    assert sorted(r["k"] for r in found) == list(range(30_000))  # every trip is placed
    counts = _counted(found)
    assert _chi_square({o: sum(c.values()) for o, c in counts.items()}, {r[0]: r[2] + 1 for r in nodes}) < 4
    for origin in sorted(counts, key=lambda o: -sum(counts[o].values()))[:12]:
        assert _chi_square(counts[origin], _gravity(nodes, origin)) < 4.5


def test_bounds_hold(spark):
    nodes = _nodes(200, 45.0)
    own = draws.tree(spark.createDataFrame(nodes, KINDS).withColumnRenamed("degree", "w"), ["w"], 3)
    assert own.levels == 2
    cells = [(p["cell"], c["id"], c) for kids in own.kids for p in kids.collect() for c in p["kids"]]
    leaves = {}
    for r in own.places.collect():
        leaves.setdefault(r["cell"], []).append(r)
    assert sum(c["w"] for _, i, c in cells if i in leaves) == sum(r[2] for r in nodes)
    rows = spark.createDataFrame([(n[0], n[3], n[4]) for n in nodes[:40]], "origin string, lat double, lon double")
    found = rows.crossJoin(own.kids[1]).selectExpr("*", "explode(kids) AS c")
    near, far = draws._ends(found["c"])
    for r in found.select("lat", "lon", "c", near.alias("near"), far.alias("far")).collect():
        for p in leaves[r["c"]["id"]]:
            assert r["near"] <= _km((r["lat"], r["lon"]), (p["lat"], p["lon"])) <= r["far"]


def test_who_cannot_go_anywhere(spark):
    nodes = [(f"n{i}", i, 1, 40.0 + i * 1e-5, -80.0) for i in range(3)]
    kinds = "k long, home string, commute_min int"
    assert generate.gaussian_pairs(spark.createDataFrame([(1, "n0", 5)], kinds), spark.createDataFrame(nodes, KINDS), 1).count() == 0  # all within 0.1 km
    far = spark.createDataFrame([*nodes, ("n9", 9, 0, 60.0, 20.0)], KINDS)
    assert generate.gaussian_pairs(spark.createDataFrame([(1, "n0", 5)], kinds), far, 1).count() == 0  # too far for a number
    trips = spark.range(20).withColumnRenamed("id", "k")
    one = spark.createDataFrame(nodes[:1], KINDS)
    assert generate.uniform_pairs(trips, one, 1).count() == 0
    two = spark.createDataFrame(nodes[:2], KINDS)
    pairs = generate.gravity_pairs(trips, two, 1).collect()
    assert len(pairs) == 20 and {(r["origin"], r["destination"]) for r in pairs} == {("n0", "n1"), ("n1", "n0")}
    assert generate.gravity_pairs(trips.limit(0), two, 1).count() == 0
    assert generate.gravity_pairs(trips, one.limit(0), 1).count() == 0


def test_uniform_pairs_are_even(spark):
    nodes = spark.createDataFrame([(f"n{i}", i * 700, 1, 0.0, 0.0) for i in range(8)], KINDS)
    found = generate.uniform_pairs(spark.range(11_200).withColumnRenamed("id", "k"), nodes, 5).collect()
    counts = {}
    for r in found:
        counts[r["origin"], r["destination"]] = counts.get((r["origin"], r["destination"]), 0) + 1
    assert len(found) == 11_200 and len(counts) == 56 and all(a != b for a, b in counts)
    assert _chi_square(counts, dict.fromkeys(counts, 1)) < 4


def test_uniform_pairs_keep_what_a_trip_has(spark):
    """Trips are numbered before they get their ends, so the number goes along."""
    nodes = spark.createDataFrame([(f"n{i}", i * 700, 1, 0.0, 0.0) for i in range(8)], KINDS)
    trips = spark.range(300).selectExpr("id AS k", "299 - id AS n")
    found = generate.uniform_pairs(trips, nodes, 5)
    bare = generate.uniform_pairs(trips.select("k"), nodes, 5)
    assert sorted(found.columns) == ["destination", "k", "n", "origin"]
    assert all(r["n"] == 299 - r["k"] for r in found.collect())
    assert sorted(found.select("k", "origin", "destination").collect()) == sorted(bare.select("k", "origin", "destination").collect())


def test_census_budgets_are_filled(spark):
    nodes = spark.createDataFrame(_nodes(60), KINDS)
    people = [(i, f"n{i % 50}", None if i % 4 == 0 else f"n{(i * 7 + 1) % 50}", f"n{i % 9}" if i % 3 == 0 else None, i % 60, "car", i) for i in range(200)]
    crowd = spark.createDataFrame(people, "id long, home string, work string, school string, commute_min int, mode string, place long")
    for am, pm in ((400, 390), (50, 0), (0, 330)):
        found = generate.census_trips(crowd, nodes, am, pm, 42, 21_600, 80_000).collect()
        morning = [r for r in found if r["purpose"] in ("HBW_AM", "HBSchool_AM", "HBW_AM_chained")]
        assert (len(morning), len(found) - len(morning)) == (am, pm)
        assert all(r["origin"] != r["destination"] for r in found)
        drawn = [r for r in found if r["dest_source"] == "gravity"]
        assert bool(drawn) == (am > 200 or pm > 200)
    # drawn homes count by who lives there; afternoons end at home
    counts = {}
    for r in generate.fallback_trips(crowd, nodes, 0, 8_000, 1, 21_600, 80_000).collect():
        counts[r["destination"]] = counts.get(r["destination"], 0) + 1
    assert _chi_square(counts, {f"n{i}": 4 for i in range(50)}) < 4


def test_top_cells_are_walked_without_a_join(spark, monkeypatch):
    nodes = spark.createDataFrame(_nodes(300), KINDS).withColumnRenamed("degree", "w")
    own = draws.tree(nodes, ["w"], 2)
    assert own.levels == 2
    pull = draws.Component("w", draws.F.lit(2.0), lambda m, a, b, col: 1 / (a + 0.1), lambda d: 1 / (d + 0.1))
    rows = nodes.selectExpr("idx AS k", "node AS origin", "lat", "lon", "0 AS j")
    assert draws._tried(rows, own, [pull], 1)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the places of leaves
    found = lambda: sorted(map(tuple, draws._tried(rows, own, [pull], 1).collect()))
    whole = found()
    assert whole
    monkeypatch.setattr(draws, "TOP_LEVELS", 1)
    assert found() == whole


def test_people_and_nodes_are_computed_once(spark):
    """What census and fallback trips read in many places is read from a file, not made anew."""
    seen = spark.sparkContext.accumulator(0)
    plain = lambda x: seen.add(1) or x
    nodes = spark.createDataFrame(_nodes(60), KINDS).select(generate.F.udf(plain)("node").alias("node"), "idx", "degree", "lat", "lon")
    people = spark.createDataFrame([(i, f"n{i % 50}", f"n{(i * 7 + 1) % 50}", None, i % 60, "car", i) for i in range(40)], "id long, home string, work string, school string, commute_min int, mode string, place long")
    for make in (generate.census_trips, generate.fallback_trips):
        seen.value = 0
        assert make(people, nodes, 60, 50, 42, 21_600, 80_000).count() == 110
        assert seen.value == 60
