"""Grouped statistics of runs: means, confidence intervals, reproducibility, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions import numbers
from corridor.operators.ranges import value_at

#: Two-sided 95 % critical values of Student's t for 1 to 30 degrees of freedom; beyond, the normal's.
T_CRITICAL = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
T_NORMAL = 1.96


def t_critical(n: Column) -> Column:
    """Critical value for ``n`` values: 0 for one, by table up to 31, then the normal's."""
    table = F.array(*map(F.lit, T_CRITICAL))
    return F.when(n <= 1, 0.0).when(n <= 31, F.get(table, (n - 2).cast("int"))).otherwise(T_NORMAL)


def half_width(n: Column, std: Column) -> Column:
    """Half of the 95 % confidence interval of a mean."""
    return F.when(n < 2, 0.0).otherwise(t_critical(n) * std / F.sqrt(n))


def reproducibility(n: Column, mean: Column, std: Column) -> Column:
    """1 - std / mean, not below 0; 1 for mean 0, NaN for fewer than two values."""
    return F.when(n < 2, F.lit(float("nan"))).when(mean == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - std / mean))


def cell_stats(runs: DataFrame) -> DataFrame:
    """One row a (scenario, engine, mode): counts, runtimes, travel times above zero, reproducibility."""
    ok = F.col("status") == "success"
    runtime, tt = F.when(ok, F.col("runtime_s")), F.when(ok & (F.col("tt_mean") > 0), F.col("tt_mean"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = runs.groupBy("scenario", "engine", "mode").agg(
        F.count("*").alias("runs"),
        F.count(runtime).alias("successes"),
        zero(F.avg(runtime)).alias("mean_runtime"),
        zero(F.stddev_samp(runtime)).alias("std_runtime"),
        zero(F.min(runtime)).alias("min_runtime"),
        zero(F.max(runtime)).alias("max_runtime"),
        zero(F.avg(F.when(ok, F.col("trip_count")))).alias("mean_trips"),
        F.count(tt).alias("n_tt"),
        zero(F.avg(tt)).alias("mean_tt"),
        zero(F.stddev_samp(tt)).alias("std_tt"),
    )
    return base.withColumns(
        {
            "r": reproducibility(F.col("n_tt"), F.col("mean_tt"), F.col("std_tt")),
            "ci_runtime": half_width(F.col("successes"), F.col("std_runtime")),
            "ci_tt": half_width(F.col("n_tt"), F.col("std_tt")),
        }
    )


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Floating-point columns rounded, for comparison across engines."""
    return df.select(*(numbers.rounded(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def reproducibility_index(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Coefficient of variation and index by ``abs(mean)``; a mean near 0 gives 1 only where all values are near 0."""
    near = 1e-10
    base = values.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.bool_and(F.abs(value) < near).alias("flat"),
    )
    tiny = F.abs("mean") < near
    return base.where("n >= 2").select(
        *keys,
        "n",
        "mean",
        "std",
        "min",
        "max",
        F.when(tiny, F.when(F.col("flat"), 0.0).otherwise(float("inf"))).otherwise(F.col("std") / F.abs("mean")).alias("cv"),
        F.when(tiny, F.when(F.col("flat"), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("std") / F.abs("mean"))).alias("r"),
    )


def floor_percentile(values: DataFrame, keys: list[str], value: str, percent: int = 95, of_n: bool = False, weight: str | None = None) -> DataFrame:
    """Per group: total weight ``n`` and the value at index ``floor(percent/100 * (n-1))`` of the sorted values.

    ``of_n`` takes ``floor(percent/100 * n)``, clamped. Values are counted first, and only the
    range that holds the index is sorted.
    """
    w = F.col(weight) if weight else F.lit(1)
    counts = values.groupBy(*keys, F.col(value).alias("p")).agg(F.sum(w).cast("long").alias("w")).where("w > 0")
    index = F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1) if of_n else F.floor((F.col("n") - 1) * percent / 100)
    return value_at(counts, keys, "p", "w", index).select(*keys, "n", "p")


def summary_by_engine(cells: DataFrame) -> DataFrame:
    """Means of cell means by engine; the index over cells with two successes or more and a number."""
    good = (F.col("successes") >= 2) & ~F.isnan("r")
    return cells.where("successes > 0").groupBy("engine").agg(
        F.count("*").alias("cells"),
        F.avg("mean_runtime").alias("mean_runtime"),
        F.avg("mean_tt").alias("mean_tt"),
        F.avg(F.when(good, F.col("r"))).alias("mean_r"),
    )


def mode_comparison(runs: DataFrame) -> DataFrame:
    """Micro against meso by (scenario, engine), where both exist: means, speedup and differences in percent of meso."""
    ok = runs.where("status = 'success'").groupBy("scenario", "engine").pivot("mode", ["meso", "micro"])
    wide = ok.agg(F.avg("runtime_s").alias("runtime"), F.avg("tt_mean").alias("tt"), F.avg("tt_p95").alias("p95")).where("meso_runtime IS NOT NULL AND micro_runtime IS NOT NULL")
    percent = lambda x: F.try_divide(F.col(f"micro_{x}") - F.col(f"meso_{x}"), F.col(f"meso_{x}")) * 100
    return wide.select(
        "scenario", "engine", "meso_runtime", "micro_runtime", "meso_tt", "micro_tt", "meso_p95", "micro_p95",
        F.try_divide("micro_runtime", "meso_runtime").alias("speedup"),
        percent("runtime").alias("runtime_diff_pct"), percent("tt").alias("tt_diff_pct"), percent("p95").alias("p95_diff_pct"),
    )


def speedup(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean runtime of the baseline engine over each other's, by (scenario, mode)."""
    means = runs.where("status = 'success'").groupBy("scenario", "mode", "engine").agg(F.avg("runtime_s").alias("runtime"))
    base = means.where(F.col("engine") == baseline).select("scenario", "mode", F.col("runtime").alias("base"))
    return means.where(F.col("engine") != baseline).join(base, ["scenario", "mode"]).select("scenario", "mode", "engine", F.try_divide("base", "runtime").alias("speedup"))


def scalability(runs: DataFrame, simulated_s: float, cores: int, watts: float) -> DataFrame:
    """Throughput of each cell's mean run: trips a second (also by core and watt) and simulated against real time; 0 without a runtime."""
    good = runs.where("status = 'success' AND runtime_s > 0 AND trip_count > 0")
    means = good.groupBy("scenario", "engine", "mode").agg(F.avg("runtime_s").alias("runtime"), F.avg("trip_count").alias("trips"))
    rate = lambda x: F.when(F.col("runtime") > 0, x / F.col("runtime")).otherwise(0.0)
    return means.withColumns(
        {
            "trips_per_s": rate(F.col("trips")),
            "simulated_per_real": rate(F.lit(simulated_s)),
            "trips_per_s_core": rate(F.col("trips")) / cores,
            "trips_per_s_watt": rate(F.col("trips")) / watts,
        }
    )


def weighted_trips(agents: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of rows (``tt, distance, volume``) that stand for ``volume`` trips each, rounded half to even.

    ``trip_count`` counts all trips, ``completed`` those with a time above 0, which alone enter the
    means and the percentile; non-finite values are left out; without a completed trip all are 0.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = agents.where(finite("tt") & finite("distance") & finite("volume") & (F.col("volume") > 0)).withColumn("n", F.bround("volume", 0).cast("long")).where("n > 0")
    done = F.when(F.col("tt") > 0, F.col("n"))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * done), F.sum(done)), F.lit(0.0))
    base = rows.groupBy(*keys).agg(
        F.sum("n").alias("trip_count"), F.coalesce(F.sum(done), F.lit(0)).alias("completed"), mean("tt").alias("mean_tt"), mean("distance").alias("mean_distance")
    )
    p95 = floor_percentile(rows.where("tt > 0"), keys, "tt", weight="n").select(*keys, F.col("p").alias("p95_tt"))
    joined = base.join(p95, keys, "left") if keys else base.join(F.broadcast(p95), how="left")  # one row each
    return joined.withColumn("p95_tt", F.coalesce("p95_tt", F.lit(0.0)))


def coverage_gap(runs: DataFrame) -> DataFrame:
    """Cells (engine, mode) that a scenario lacks among those that any scenario has, failed ones too."""
    cells, scenarios = runs.select("engine", "mode").distinct(), runs.select("scenario").distinct()
    # names of cells and scenarios: a report's axes, not rows
    return scenarios.crossJoin(cells).join(runs.select("scenario", "engine", "mode").distinct(), ["scenario", "engine", "mode"], "left_anti")
