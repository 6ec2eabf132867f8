"""Documents in part files: no element is cut between two of them."""

from pyspark.sql import functions as F

from corridor.sinks import files as out
from corridor.sinks import lines
from corridor.sources import files as src


def test_elements_of_several_lines_stay_in_one_part(spark, tmp_path):
    trips = spark.range(500).select(F.concat(F.lit("t"), "id").alias("trip_id"), F.col("id").alias("depart"), F.array(F.lit("l1"), F.lit("l2")).alias("links"))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        path = str(tmp_path / "routes")
        lines.write(out.sumo_routes(trips, "std"), path)
        read = src.sumo_routes(spark, path).select("trip_id", F.array_join("links", " ")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, read)) == sorted((f"t{i}", "l1 l2") for i in range(500))
    text = [x for p in sorted((tmp_path / "routes").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(list((tmp_path / "routes").glob("part-*"))) > 8
    assert text[1] == "<routes>" and text[-1] == "</routes>" and [x.split()[0] for x in text[3:6]] == ["<vehicle", "<route", "</vehicle>"]
