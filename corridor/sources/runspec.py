"""Benchmark matrices: which runs a study plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.functions.identity import ENGINES, short_mode

REQUIRED = ("scenario", "engine", "mode")


def matrix(spark: SparkSession, spec: dict) -> DataFrame:
    """``scenario, engine, mode, seed`` of each planned run. Lacking keys, unknown engines and repeats below 1 raise."""
    rows = []
    for i, entry in enumerate(spec.get("scenarios", [])):
        if lacking := [k for k in REQUIRED if not entry.get(k)]:
            raise ValueError(f"entry {i} lacks {', '.join(lacking)}")
        if entry["engine"] not in ENGINES:
            raise ValueError(f"entry {i} names the unknown engine {entry['engine']}")
        if entry.get("repeats", 1) < 1:
            raise ValueError(f"entry {i} repeats less than once")
        rows.append((entry["scenario"], entry["engine"], entry["mode"], entry.get("repeats", 1), entry.get("seed", 42), entry.get("seed_increment", True)))
    return expand(spark.createDataFrame(rows, "scenario string, engine string, mode string, repeats int, seed int, rising boolean"))


def expand(plan: DataFrame) -> DataFrame:
    """The runs of planned cells (``scenario, engine, mode, repeats, seed, rising``)."""
    seed = F.col("seed") + F.when(F.col("rising"), F.col("i")).otherwise(0)
    return plan.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).select("scenario", "engine", short_mode(F.col("mode")).alias("mode"), seed.alias("seed"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The runs of JSON plans, one cell a line; defaults and errors as in ``matrix``."""
    kind = "scenario string, engine string, mode string, repeats int, seed int, seed_increment boolean"
    rows = spark.read.option("mode", "FAILFAST").schema(kind).json(path)
    lacking = F.filter(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED)), lambda c: c.isNotNull())
    wrong = (
        F.when(F.size(lacking) > 0, F.concat(F.lit("an entry lacks "), F.array_join(lacking, ", "))).when(~F.col("engine").isin(*ENGINES), F.concat(F.lit("unknown engine "), "engine"))
        .when(F.coalesce("repeats", F.lit(1)) < 1, F.lit("an entry repeats less than once"))
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise(F.coalesce("repeats", F.lit(1)))
    return expand(rows.select("scenario", "engine", "mode", checked.alias("repeats"), F.coalesce("seed", F.lit(42)).alias("seed"), F.coalesce("seed_increment", F.lit(True)).alias("rising")))
