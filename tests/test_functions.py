"""Scalar functions and ranges on hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from corridor.functions import clock, geo, identity, labels, roads
from corridor.operators import network, ranges, reports, statistics


def _one(spark, values, kind, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clock(spark):
    assert _one(spark, ["01:23:45.5", "garbage", None, "1:2", "-1:00:00"], "string", clock.hms_seconds) == [5025.5, 0.0, 0.0, 0.0, -3600.0]
    assert _one(spark, [5025, -7, 360_000], "long", clock.to_hms) == ["01:23:45", "00:00:00", "100:00:00"]
    assert _one(spark, [30, 60, 500], "int", lambda x: clock.departure(x, 25_200, 27_100)) == [27_000, 25_200, 25_200]


def test_identity(spark):
    ids = ["chicago_1k_sumo_meso", "plain", None, "sumoton_200k", "x_matsim"]
    found = _one(spark, ids, "string", lambda x: F.concat_ws("|", *identity.from_scenario_id(x).values()))
    assert found == ["chicago_1k|sumo|meso", "plain|unknown|unknown", "unknown|unknown|unknown", "sumoton_200k|unknown|unknown", "x|matsim|unknown"]
    assert _one(spark, ["a_10k_b", "b", "k_5k"], "string", identity.size_tier) == [10, 0, 5]
    assert _one(spark, ["n42", "17"], "string", identity.int_index) == [42, 17]
    with pytest.raises(Exception, match="no number in id"):
        _one(spark, ["n4x"], "string", identity.int_index)
    errors = ["Conversion failed: netconvert failed: Warning: A\nWarning: B\n\nC", None, " ", "x" * 90, "word " * 30]
    assert _one(spark, errors, "string", identity.one_line_error) == ["A (+2 more)", "unknown error", "unknown error", "x" * 80 + "…", ("word " * 16).strip() + "…"]


def test_roads(spark):
    assert _one(spark, ["50", "30 mph", None, "fast"], "string", lambda x: roads.speed_mps(x, F.lit("service"))) == [13.9, 13.4, 8.3, 8.3]
    assert _one(spark, [["path", "service", "trunk"], [], ["b", "a"]], "array<string>", roads.pick_class) == ["trunk", "residential", "a"]
    assert _one(spark, ["[1, 2,x]", "3", None], "string", roads.way_ids) == [[1, 2], [3], []]
    assert _one(spark, [1, 2, 9, 10, 11, -1], "int", roads.mode_of) == ["car", "transit", "bike", "walk", "home", "car"]


def test_labels_and_geo(spark):
    assert _one(spark, [None, 0.995, 0.96, 0.8, 0.2], "double", labels.scorecard_grade) == ["N/A", "EXCELLENT", "GOOD", "ACCEPTABLE", "POOR"]
    assert _one(spark, [0, 10, 1000, 10**9], "long", geo.colour_index) == [32, 32, 92, 132]
    assert abs(_one(spark, [1.0], "double", lambda x: geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), x))[0] - 111.19) < 0.01


def test_ranges(spark):
    rnd = random.Random(4)
    rows = sorted((rnd.choice((rnd.randint(0, 40), rnd.randint(0, 10**9))), i) for i in range(400))
    df = spark.createDataFrame(rows, "x long, i long")
    found = {r["i"]: r["next"] for r in ranges.with_next(df, "i", ["x", "i"], F.floor(F.col("x") / 7)).collect()}
    assert found == {i: n[1] if n else None for (_, i), n in zip(rows, [*rows[1:], None])}
    found = {r["i"]: r["k"] for r in ranges.numbered(df, ["x", "i"], F.floor(F.col("x") / 7), "k").collect()}
    assert found == {i: k for k, (_, i) in enumerate(rows)}
    counts = df.groupBy("x").agg(F.count("*").alias("w"))
    for index in (0, 17, 399):
        assert ranges.value_at(counts.withColumn("at", F.lit(index)), [], "x", "w", "at").first()["x"] == rows[index][0]
    sums = {r["x"]: r["w_upto"] for r in ranges.running_sums(counts, [], "x", ["w"]).collect()}
    assert sums == {x: sum(y <= x for y, _ in rows) for x, _ in rows}


def test_volume_rows(spark):
    rows = [(60.0 * k, 1.0, 1.0) for k in range(1, 101)]
    schema = "tt double, distance double, volume double"
    found = statistics.weighted_trips(spark.createDataFrame([("e", *r) for r in rows], f"engine string, {schema}"), ["engine"]).first()
    assert found["p95_tt"] == 5700.0 and found["trip_count"] == 100
    rows = [("e", 0.0, 1.0, 1.0), ("e", 180.0, 1.0, 1.0), ("e", float("nan"), 1.0, 1.0), ("e", 5.0, 1.0, 0.5)]
    found = statistics.weighted_trips(spark.createDataFrame(rows, f"engine string, {schema}"), ["engine"]).first()
    assert (found["trip_count"], found["completed"], found["mean_tt"]) == (2, 1, 180.0)


def test_reports(spark):
    runs = [("s", "e", "meso", "success", 200.0), ("s", "e", "meso", "success", 0.0), ("s", "e", "meso", "success", 200.0), ("s", "e", "micro", "failed", 1.0)]
    df = spark.createDataFrame([(*r, 1.0, 2.0, 3) for r in runs], "scenario string, engine string, mode string, status string, tt_mean double, runtime_s double, tt_p95 double, trip_count long")
    cell = reports.plot_cells(df).first()
    assert (cell["mode"], cell["mean_tt"], cell["r"], cell["n_tt"]) == ("meso", 200.0, 1.0, 2)
    empty = reports.trip_stats(df.limit(0), [], "tt_mean").first()
    assert (empty["n"], empty["mean"], empty["p95"]) == (0, 0.0, 0.0)


def test_length_histogram(spark):
    rows = [(0.0,), (None,), (0.05,), (0.5,), (5.0,), (50.0,), (500.0,), (-1.0,)]
    found = {r["bucket"]: (r["links"], r["percent"]) for r in network.length_histogram(spark.createDataFrame(rows, "length double")).collect()}
    assert found == {"0": (2, 25.0), "<0.1": (2, 25.0), "<1": (1, 12.5), "<10": (1, 12.5), "<100": (1, 12.5), ">=100": (1, 12.5)}
