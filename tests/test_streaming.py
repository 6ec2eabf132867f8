"""Streams against the same operators over tables."""

import random

from pyspark.sql import functions as F

from corridor.operators import events as tables
from corridor.streaming import events as streams

KIND = "pos long, veh long, link long, type string, at timestamp"


def _finish(stream, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    return spark.table(name)


def test_streams_equal_tables(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 4), rnd.randint(1, 2), rnd.choice(["entered", "left", "other"]), 1_700_000_000 + i * 20) for i in range(200)]
    rows.append((999, 1, 1, "entered", 1_700_000_000 + 900_000))  # closes all bins
    df = spark.createDataFrame(rows, "pos long, veh long, link long, type string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    for k in range(4):
        df.where(F.floor((F.col("pos") % 1000) / 50) == k).coalesce(1).write.mode("append").json(str(tmp_path))
    df.where("pos = 999").coalesce(1).write.mode("append").json(str(tmp_path))
    source = lambda: spark.readStream.schema(KIND).json(str(tmp_path))
    plain = df.withColumn("t", F.unix_micros("at"))
    found = _finish(streams.throughput(source(), "10 minutes", "1 hour"), "bins", spark)
    wanted = tables.throughput(plain.where("pos < 999"), 600_000_000)
    assert sorted(map(tuple, found.select(F.unix_micros("bin"), "link", "n").collect())) == sorted(map(tuple, wanted.select("bin", "link", "n").collect()))
    found = _finish(streams.visits(source(), "1 day", 86_400_000), "stays", spark)
    wanted = tables.visits(plain.where("type <> 'other'"))
    assert sorted(map(tuple, found.select("veh", "link", F.unix_micros("t_in"), F.unix_micros("t_out")).collect())) == sorted(map(tuple, wanted.collect()))


def test_visits_pair_by_time_across_batches(spark, tmp_path):
    """Files whose events are out of order, one file a batch."""
    rnd = random.Random(8)
    rows = [(i, rnd.randint(1, 3), 1, rnd.choice(["entered", "left"]), 1_700_000_000 + i * 20) for i in range(120)]
    shuffled = rnd.sample(rows, len(rows))
    last = (999, 1, 1, "entered", 1_700_000_000 + 900_000)
    frame = lambda own: spark.createDataFrame(own, "pos long, veh long, link long, type string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    for own in (shuffled[:40], shuffled[40:80], shuffled[80:], [last]):
        frame(own).coalesce(1).write.mode("append").json(str(tmp_path))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    found = _finish(streams.visits(source, "1 day", 86_400_000), "shuffled_stays", spark)
    wanted = tables.visits(frame(rows).withColumn("t", F.unix_micros("at")))
    got = sorted(map(tuple, found.select("veh", "link", F.unix_micros("t_in"), F.unix_micros("t_out")).collect()))
    assert got and got == sorted(map(tuple, wanted.collect()))
