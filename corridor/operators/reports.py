"""Frames behind tables and figures of run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.functions import labels
from corridor.operators.ranges import running_sums
from corridor.operators.statistics import floor_percentile, half_width, reproducibility

CELL = ["scenario", "engine", "mode"]


def plot_cells(runs: DataFrame) -> DataFrame:
    """Cells with a success: runtimes, travel times above zero, mean p95, whole trips, index and confidence."""
    ok = F.col("status") == "success"
    tt = F.when(ok & (F.col("tt_mean") > 0), F.col("tt_mean"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    runtime = F.when(ok, F.col("runtime_s"))
    base = runs.groupBy(*CELL).agg(
        F.count("*").alias("runs"), F.count(runtime).alias("successes"), F.avg(runtime).alias("mean_runtime"), zero(F.stddev_samp(runtime)).alias("std_runtime"),
        F.avg(F.when(ok, F.col("trip_count"))).cast("long").alias("trips"), F.count(tt).alias("n_tt"), zero(F.avg(tt)).alias("mean_tt"),
        zero(F.stddev_samp(tt)).alias("std_tt"), F.avg(F.when(ok, F.col("tt_p95"))).alias("mean_p95"),
    ).where("successes > 0")
    return base.withColumns(
        {
            "r": reproducibility(F.col("n_tt"), F.col("mean_tt"), F.col("std_tt")),
            "ci_runtime": half_width(F.col("successes"), F.col("std_runtime")),
            "ci_tt": half_width(F.col("n_tt"), F.col("std_tt")),
        }
    )


def plain_index(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and index of each group: NaN of one value, 1 of mean 0, not below 0."""
    base = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return base.select(*keys, "n", reproducibility(F.col("n"), F.col("mean"), F.col("std")).alias("r"))


def unclamped_index(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The scorecard's index: may be negative; null of mean 0 and of one value."""
    base = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_tt"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev_tt"))
    return base.withColumn("r", F.when((F.col("n") >= 2) & (F.col("mean_tt") != 0), 1 - F.col("stdev_tt") / F.col("mean_tt")))


def with_reading(index: DataFrame) -> DataFrame:
    return index.withColumn("reading", labels.index_reading(F.col("r")))


def several_indices(runs: DataFrame, keys: list[str], kpis: list[str], index) -> DataFrame:
    """Mean of the indices of several measures; a missing value counts as 0."""
    rows = runs.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("kpi"), F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias("v")) for k in kpis))).alias("m"))
    by = index(rows.select(*keys, "m.kpi", "m.v"), [*keys, "kpi"], "v")
    return by.groupBy(*keys).agg(F.max("n").alias("runs"), F.count("*").alias("kpis"), F.avg("r").alias("overall_r"))


def trip_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, p95, least and greatest value of each group; without keys one row, of zeros where there is no value."""
    base = values.groupBy(*keys).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    p95 = floor_percentile(values, keys, value).withColumnRenamed("p", "p95").drop("n")
    both = base.join(p95, keys, "left") if keys else base.join(F.broadcast(p95), how="left")  # one row each
    return both.withColumn("p95", F.coalesce("p95", F.lit(0.0)))


def quartiles(values: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Count and quantiles of each group, linear between neighbours. Values are counted and ordered by ranges."""
    counts = values.groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("w"))
    totals = counts.groupBy(*keys).agg(F.sum("w").alias("n"))
    sums = running_sums(counts, keys, "x", ["w"])
    run = sums.join(totals, keys) if keys else sums.crossJoin(F.broadcast(totals))  # one row
    place = lambda q: (F.col("n") - 1) * q
    at = lambda k: F.max(F.when((F.col("w_upto") > k) & (F.col("w_upto") - F.col("w") <= k), F.col("x")))
    parts = [p for i, q in enumerate(shares) for p in (at(F.floor(place(q))).alias(f"lo{i}"), at(F.ceil(place(q))).alias(f"hi{i}"))]
    held = run.groupBy(*keys, "n").agg(*parts)
    between = lambda i, q: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(q) - F.floor(place(q)))
    return held.select(*keys, "n", *(between(i, q).alias(f"q{round(q * 100)}") for i, q in enumerate(shares)))


def wall_split(runs: DataFrame) -> DataFrame:
    """Mean seconds of the engine, of the whole cell and of what comes before the engine."""
    by = runs.where("status = 'success'").groupBy(*CELL).agg(F.avg("engine_wall_s").alias("engine_s"), F.avg(F.coalesce("cell_wall_s", "engine_wall_s")).alias("cell_s"))
    return by.withColumn("prepare_s", F.greatest(F.lit(0.0), F.col("cell_s") - F.col("engine_s")))


def wall_ci(runs: DataFrame) -> DataFrame:
    """Mean seconds of a cell with its confidence, and of its engine."""
    wall = F.when(F.coalesce("cell_wall_s", F.lit(0.0)) > 0, F.col("cell_wall_s")).otherwise(F.col("runtime_s"))
    by = runs.where("status = 'success'").groupBy(*CELL).agg(
        F.count("*").alias("n"), F.avg(wall).alias("mean_wall"), F.coalesce(F.stddev_samp(wall), F.lit(0.0)).alias("std_wall"), F.avg("engine_wall_s").alias("mean_engine")
    )
    return by.select(*CELL, "n", "mean_wall", half_width(F.col("n"), F.col("std_wall")).alias("ci_wall"), "mean_engine")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``: a later file's cell replaces an earlier one's. Partial maxima, no sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("r")).select(*keys, "r.*")


def with_breaks(cells: DataFrame) -> DataFrame:
    """``cells`` in the order of a report, with ``breaks`` where the scenario changes. A report's cells, not rows."""
    order = W.orderBy(*CELL)
    before = F.lag("scenario").over(order)
    return cells.withColumns({"line": F.row_number().over(order), "breaks": before.isNotNull() & (before != F.col("scenario"))})


def same_everywhere(reports: DataFrame, key: str, measures: list[str], ids: str | None = None) -> DataFrame:
    """For each key: reports, whether all agree in ``measures`` (missing: 0) and in their set of ``ids``."""
    values = F.struct(*(F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures))
    out = [F.count("*").alias("reports"), (F.count_distinct(values) == 1).alias("counts_same")]
    if ids:
        out.append((F.count_distinct(F.coalesce(F.array_sort(ids), F.array().cast("array<string>"))) == 1).alias("ids_same"))
    return reports.groupBy(key).agg(*out)


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)
