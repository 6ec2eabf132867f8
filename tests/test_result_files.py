"""Result files: more runs make more files, not larger ones."""

from pyspark.sql import functions as F

from corridor import views
from corridor.plans import files

DIR = "/root/testdata/sf0.001"


def test_files_are_bounded_and_hold_all_runs(spark, monkeypatch):
    monkeypatch.setattr(files, "RUNS_A_BLOCK", 1_000, raising=False)
    runs = views.runs(spark, DIR)
    n, largest = runs.count(), runs.groupBy("scenario", "seed").count().agg(F.max("count")).first()[0]
    docs = spark.read.option("multiLine", True).schema("results array<struct<seed: int>>, runs array<struct<seed: int>>").json(files._results(spark, DIR))
    sizes = [r[0] for r in docs.select(F.size(F.coalesce("results", "runs"))).collect()]
    assert sum(sizes) == n and max(sizes) < largest / 3
