"""Queries on run reports, coverage, audits and figure frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import views
from corridor.functions import labels, numbers
from corridor.operators import fidelity, reports, statistics
from corridor.operators.statistics import rounded
from corridor.plans.statistics import _CELLS, _CI
from corridor.registry import query

CELL = ["scenario", "engine", "mode"]
_R = "CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE WHEN avg(v) = 0 THEN 1.0 ELSE greatest(0.0, 1 - stddev_samp(v) / avg(v)) END"


def _runs(spark, sf_dir):
    return views.runs(spark, sf_dir)


def _ok(spark, sf_dir):
    return _runs(spark, sf_dir).where("status = 'success'")


def _sql(select):
    return views.with_views("runs", select)


_PLOT = (
    f", plots AS (SELECT *, {_CI.format(n='successes', s='std_runtime')} AS ci_runtime, {_CI.format(n='n_tt', s='std_tt')} AS ci_tt, "
    "CASE WHEN n_tt < 2 THEN 'NaN'::DOUBLE WHEN mean_tt = 0 THEN 1.0 ELSE greatest(0.0, 1 - std_tt / mean_tt) END AS r FROM (SELECT scenario, engine, mode, count(*) AS runs, "
    "count(*) FILTER (status = 'success') AS successes, avg(runtime_s) FILTER (status = 'success') AS mean_runtime, coalesce(stddev_samp(runtime_s) FILTER (status = 'success'), 0) AS std_runtime, "
    "CAST(trunc(avg(trip_count) FILTER (status = 'success')) AS BIGINT) AS trips, count(*) FILTER (status = 'success' AND tt_mean > 0) AS n_tt, "
    "coalesce(avg(tt_mean) FILTER (status = 'success' AND tt_mean > 0), 0) AS mean_tt, coalesce(stddev_samp(tt_mean) FILTER (status = 'success' AND tt_mean > 0), 0) AS std_tt, "
    "avg(tt_p95) FILTER (status = 'success') AS mean_p95 FROM runs GROUP BY scenario, engine, mode) WHERE successes > 0) "
)
_FOUR = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)


@query("agg_cell_stats_plots", _sql(_PLOT + f"SELECT scenario, engine, mode, runs, successes, trips, n_tt, {_FOUR('mean_runtime', 'std_runtime', 'mean_tt', 'std_tt', 'mean_p95', 'r', 'ci_runtime', 'ci_tt')} FROM plots"))
def agg_cell_stats_plots(spark, sf_dir):
    return rounded(reports.plot_cells(_runs(spark, sf_dir)))


def _figure(name, columns, where="true"):
    """A figure's frame: some columns of the cells."""
    texts = [c for c in columns if c in ("scenario", "engine", "mode", "trips", "successes")]
    rest = [c for c in columns if c not in texts]
    select = ", ".join(texts + [f"round({c}, 4) AS {c}" for c in rest])

    def run(spark, sf_dir):
        return rounded(reports.plot_cells(_runs(spark, sf_dir)).where(where).select(*texts, *rest))

    query(name, _sql(_PLOT + f"SELECT {select} FROM plots WHERE {where}"))(run)


_figure("fig_5_1", [*CELL, "mean_runtime", "ci_runtime"])
_figure("fig_5_3", [*CELL, "mean_tt", "ci_tt"], "mean_tt > 0")
_figure("fig_5_7", [*CELL, "mean_p95", "mean_tt"], "mean_p95 > 0")
_figure("fig_5_8", [*CELL, "trips"])


def _wide(name, value):
    """A figure's matrix: one column a mode, null where a cell is not run."""

    def run(spark, sf_dir):
        cells = reports.plot_cells(_runs(spark, sf_dir))
        return rounded(cells.groupBy("scenario", "engine").pivot("mode", ["meso", "micro"]).agg(F.first(value)))

    query(name, _sql(_PLOT + f"SELECT scenario, engine, round(any_value({value}) FILTER (mode = 'meso'), 4) AS meso, round(any_value({value}) FILTER (mode = 'micro'), 4) AS micro FROM plots GROUP BY scenario, engine"))(run)


_wide("fig_5_2", "r")
_wide("fig_5_5", "mean_runtime")


@query("fig_5_9", views.with_views("trips", "SELECT mode, " + ", ".join(f"count(*) FILTER (purpose = '{p}') AS \"{p}\"" for p in ("HBW_AM", "HBSchool_AM", "HBW_AM_chained", "HBW_PM", "HBSchool_PM", "HBW_PM_chained")) + " FROM trips GROUP BY mode"))
def fig_5_9(spark, sf_dir):
    order = ["HBW_AM", "HBSchool_AM", "HBW_AM_chained", "HBW_PM", "HBSchool_PM", "HBW_PM_chained"]
    wide = views.trips(spark, sf_dir).groupBy("mode").pivot("purpose", order).agg(F.count("trip_id"))
    return wide.select("mode", *(F.coalesce(p, F.lit(0)).alias(p) for p in order))


@query("agg_repro_analyzer", _sql(f", x AS (SELECT *, tt_mean AS v FROM runs WHERE status = 'success' AND tt_mean > 0) SELECT scenario, engine, mode, count(*) AS n, round({_R}, 4) AS r FROM x GROUP BY ALL"))
def agg_repro_analyzer(spark, sf_dir):
    return rounded(reports.plain_index(_ok(spark, sf_dir).where("tt_mean > 0"), CELL, "tt_mean"))


@query("agg_repro_plots", _sql(f", x AS (SELECT *, tt_mean AS v FROM runs WHERE status = 'success' AND tt_mean > 0) SELECT scenario, engine, mode, seed, count(*) AS n, round({_R}, 4) AS r FROM x GROUP BY ALL"))
def agg_repro_plots(spark, sf_dir):
    return rounded(reports.plain_index(_ok(spark, sf_dir).where("tt_mean > 0"), [*CELL, "seed"], "tt_mean"))


_READ = "CASE WHEN r >= 0.99 THEN 'excellent (near-deterministic)' WHEN r >= 0.95 THEN 'very good' WHEN r >= 0.9 THEN 'good' WHEN r >= 0.8 THEN 'acceptable' WHEN r >= 0.5 THEN 'moderate variability' ELSE 'poor (high variability)' END"


@query(
    "agg_repro_metrics",
    _sql(
        ", x AS (SELECT scenario, engine, mode, count(*) AS n, avg(runtime_s) AS mean, stddev_samp(runtime_s) AS std, min(runtime_s) AS min, max(runtime_s) AS max, stddev_samp(runtime_s) / abs(avg(runtime_s)) AS cv, "
        "greatest(0.0, 1 - stddev_samp(runtime_s) / abs(avg(runtime_s))) AS r FROM runs WHERE status = 'success' GROUP BY ALL HAVING count(*) >= 2) "
        f"SELECT scenario, engine, mode, n, {_FOUR('mean', 'std', 'min', 'max', 'cv', 'r')}, {_READ} AS reading FROM x"
    ),
)
def agg_repro_metrics(spark, sf_dir):
    return rounded(reports.with_reading(statistics.reproducibility_index(_ok(spark, sf_dir), CELL, "runtime_s")))


@query("val_reproducible", _sql(", x AS (SELECT scenario, engine, mode, greatest(0.0, 1 - stddev_samp(trip_count) / abs(avg(trip_count))) AS r FROM runs WHERE status = 'success' GROUP BY ALL HAVING count(*) >= 2) SELECT scenario, engine, mode, r >= 0.42 AS reproducible FROM x"))
def val_reproducible(spark, sf_dir):
    return statistics.reproducibility_index(_ok(spark, sf_dir), CELL, "trip_count").select(*CELL, (F.col("r") >= 0.42).alias("reproducible"))


@query(
    "agg_repro_multi",
    _sql(
        ", k AS (SELECT scenario, engine, unnest(['tt_mean', 'runtime_s', 'trip_count']) AS kpi, unnest([tt_mean, runtime_s, CAST(trip_count AS DOUBLE)]) AS v FROM runs), "
        "i AS (SELECT scenario, engine, kpi, count(*) AS n, greatest(0.0, 1 - stddev_samp(v) / abs(avg(v))) AS r FROM k GROUP BY ALL) "
        "SELECT scenario, engine, max(n) AS runs, count(*) AS kpis, round(avg(r), 4) AS overall_r FROM i GROUP BY ALL"
    ),
)
def agg_repro_multi(spark, sf_dir):
    return rounded(reports.several_indices(_runs(spark, sf_dir), ["scenario", "engine"], ["tt_mean", "runtime_s", "trip_count"], statistics.reproducibility_index))


_SCORE = ", s AS (SELECT scenario, engine, mode, count(*) AS n, avg(tt_mean) AS mean_tt, coalesce(stddev_samp(tt_mean), 0) AS stdev_tt, CASE WHEN count(*) >= 2 AND avg(tt_mean) <> 0 THEN 1 - stddev_samp(tt_mean) / avg(tt_mean) END AS r FROM runs WHERE status = 'success' GROUP BY ALL)"


@query("agg_repro_scorecard", _sql(_SCORE + f" SELECT scenario, engine, mode, n, {_FOUR('mean_tt', 'stdev_tt', 'r')} FROM s"))
def agg_repro_scorecard(spark, sf_dir):
    return rounded(reports.unclamped_index(_ok(spark, sf_dir), CELL, "tt_mean"))


@query("agg_repro_harness", _sql(", x AS (SELECT scenario || '_' || engine || '_' || mode AS scenario_id, tt_mean AS v FROM runs WHERE status = 'success') " + f"SELECT scenario_id, count(*) AS n, round({_R}, 4) AS r FROM x GROUP BY 1 HAVING count(*) >= 2"))
def agg_repro_harness(spark, sf_dir):
    rows = _ok(spark, sf_dir).select(F.concat_ws("_", *CELL).alias("scenario_id"), "tt_mean")
    return rounded(reports.plain_index(rows, ["scenario_id"], "tt_mean").where("n >= 2"))


@query("agg_ci95", _sql(f", x AS (SELECT scenario, mode, seed, count(*) AS n, avg(runtime_s) AS mean, coalesce(stddev_samp(runtime_s), 0) AS s FROM runs GROUP BY ALL) SELECT scenario, mode, seed, n, round(mean, 4) AS mean, round({_CI.format(n='n', s='s')}, 4) AS half FROM x"))
def agg_ci95(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("scenario", "mode", "seed").agg(F.count("*").alias("n"), F.avg("runtime_s").alias("mean"), F.coalesce(F.stddev_samp("runtime_s"), F.lit(0.0)).alias("s"))
    return rounded(by.select("scenario", "mode", "seed", "n", "mean", statistics.half_width(F.col("n"), F.col("s")).alias("half")))


_STATS = "count(*) AS n, round(coalesce(avg(tt), 0), 4) AS mean, min(tt) AS least, max(tt) AS greatest, CAST(coalesce(list_sort(list(tt))[1 + CAST(floor((count(*) - 1) * 95 / 100) AS BIGINT)], 0) AS DOUBLE) AS p95"


@query("agg_trip_stats", views.with_views("trip_times", f"SELECT {_STATS} FROM (SELECT CAST(tt AS DOUBLE) AS tt FROM trip_times WHERE engine = 'F')"))
def agg_trip_stats(spark, sf_dir):
    return rounded(reports.trip_stats(views.trip_times(spark, sf_dir).where("engine = 'F'").withColumn("tt", F.col("tt").cast("double")), [], "tt"))


@query("agg_tt_profile", views.with_views("trip_times", f"SELECT engine, {_STATS} FROM (SELECT engine, CAST(tt AS DOUBLE) AS tt FROM trip_times WHERE tt > 0) GROUP BY engine"))
def agg_tt_profile(spark, sf_dir):
    return rounded(reports.trip_stats(views.trip_times(spark, sf_dir).where("tt > 0").withColumn("tt", F.col("tt").cast("double")), ["engine"], "tt"))


#: Two engines' trip times and link counts: root mean square over common trips, GEH over the links of either, KS over all values.
_FIDELITY = (
    ", p AS (SELECT a.tt AS x, b.tt AS y FROM trip_times a JOIN trip_times b ON a.trip_id = b.trip_id WHERE a.engine = 'F' AND b.engine = 'O'), "
    "j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT * FROM link_counts WHERE engine = 'F') a FULL JOIN (SELECT * FROM link_counts WHERE engine = 'O') b ON a.link = b.link), "
    "g AS (SELECT CASE WHEN x <= 0 OR y <= 0 THEN 'Infinity'::DOUBLE ELSE sqrt(2.0::DOUBLE * (x - y) * (x - y) / (x + y)) END AS g FROM j), "
    "v AS (SELECT tt, count(*) FILTER (engine = 'F') AS a, count(*) FILTER (engine = 'O') AS b FROM trip_times GROUP BY tt), "
    "c AS (SELECT sum(a) OVER (ORDER BY tt) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY tt) / sum(b) OVER () AS fb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM v) "
)


def _fidelity(spark, sf_dir):
    tt = views.trip_times(spark, sf_dir)
    pairs = tt.where("engine = 'F'").select("trip_id", F.col("tt").alias("a")).join(tt.where("engine = 'O'").select("trip_id", F.col("tt").alias("b")), "trip_id")
    one = fidelity.rmse(pairs, "a", "b")
    two = fidelity.geh_batch(views.link_counts(spark, sf_dir), "link", "engine", "n", "F", "O")
    three = fidelity.ks(tt, "engine", "tt", "F", "O").select("d", "critical")
    return one.crossJoin(two).crossJoin(three)  # one row each


@query(
    "agg_fidelity",
    views.with_views(
        "trip_times link_counts",
        _FIDELITY + "SELECT (SELECT count(*) FROM p) AS n, (SELECT round(sqrt(avg(CAST((x - y) * (x - y) AS DOUBLE))), 2) FROM p) AS rmse, (SELECT count(*) FROM g) AS links, "
        "(SELECT round(coalesce(avg(g) FILTER (g < 'Infinity'::DOUBLE), 'Infinity'::DOUBLE), 4) FROM g) AS mean_geh, (SELECT round(avg(CASE WHEN g < 5 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 4) FROM g) AS below_5_pct, "
        "(SELECT round(max(abs(fa - fb)), 4) FROM c) AS d, (SELECT round(1.36::DOUBLE * sqrt((max(n) + max(m)) / (max(n) * max(m))), 4) FROM c) AS critical",
    ),
)
def agg_fidelity(spark, sf_dir):
    return rounded(_fidelity(spark, sf_dir)).withColumn("rmse", numbers.rounded("rmse", 2))


@query("join_matched_trips", views.with_views("trip_times", "SELECT a.trip_id, a.tt AS a, b.tt AS b, abs(a.tt - b.tt) AS gap FROM trip_times a JOIN trip_times b ON a.trip_id = b.trip_id WHERE a.engine = 'F' AND b.engine = 'O'"))
def join_matched_trips(spark, sf_dir):
    tt = views.trip_times(spark, sf_dir)
    pairs = tt.where("engine = 'F'").select("trip_id", F.col("tt").alias("a")).join(tt.where("engine = 'O'").select("trip_id", F.col("tt").alias("b")), "trip_id")
    return pairs.withColumn("gap", F.abs(F.col("a") - F.col("b")))


@query("set_intersect_ids", views.with_views("trip_times", "SELECT trip_id FROM trip_times WHERE engine = 'F' INTERSECT SELECT trip_id FROM trip_times WHERE engine = 'O'"))
def set_intersect_ids(spark, sf_dir):
    tt = views.trip_times(spark, sf_dir)
    return tt.where("engine = 'F'").select("trip_id").intersect(tt.where("engine = 'O'").select("trip_id"))


@query("set_union_links", views.with_views("link_counts", "SELECT link FROM link_counts WHERE engine = 'F' UNION SELECT link FROM link_counts WHERE engine = 'O'"))
def set_union_links(spark, sf_dir):
    counts = views.link_counts(spark, sf_dir)
    return counts.where("engine = 'F'").select("link").union(counts.where("engine = 'O'").select("link")).distinct()


#: Runs with wall times of the cell and of the engine; some cells have none.
_WALL = [
    "CASE WHEN seed = 3 THEN NULL ELSE runtime_s + trip_count % 7 END AS cell_wall_s",
    "CASE WHEN seed = 5 THEN runtime_s * 2 ELSE runtime_s / 2 END AS engine_wall_s",
]


def _walls(spark, sf_dir):
    return _runs(spark, sf_dir).selectExpr("*", *_WALL)


def _wall_sql(select):
    return _sql(f", w AS (SELECT *, {', '.join(_WALL)} FROM runs WHERE status = 'success') {select}")


@query("agg_wall_split", _wall_sql(", m AS (SELECT scenario, engine, mode, avg(engine_wall_s) AS engine_s, avg(coalesce(cell_wall_s, engine_wall_s)) AS cell_s FROM w GROUP BY ALL) SELECT scenario, engine, mode, round(engine_s, 4) AS engine_s, round(cell_s, 4) AS cell_s, round(greatest(0, cell_s - engine_s), 4) AS prepare_s FROM m"))
def agg_wall_split(spark, sf_dir):
    return rounded(reports.wall_split(_walls(spark, sf_dir)))


@query("agg_wall_ci", _wall_sql(f", m AS (SELECT scenario, engine, mode, count(*) AS n, avg(x) AS mean_wall, coalesce(stddev_samp(x), 0) AS s, avg(engine_wall_s) AS mean_engine FROM (SELECT *, CASE WHEN coalesce(cell_wall_s, 0) > 0 THEN cell_wall_s ELSE runtime_s END AS x FROM w) GROUP BY ALL) SELECT scenario, engine, mode, n, round(mean_wall, 4) AS mean_wall, round({_CI.format(n='n', s='s')}, 4) AS ci_wall, round(mean_engine, 4) AS mean_engine FROM m"))
def agg_wall_ci(spark, sf_dir):
    return rounded(reports.wall_ci(_walls(spark, sf_dir)))


@query("agg_runtime_dist", _wall_sql("SELECT engine, mode, count(*) AS n, " + ", ".join(f"round(quantile_cont(x, {q / 100}), 4) AS q{q}" for q in (0, 25, 50, 75, 100)) + " FROM (SELECT engine, mode, coalesce(cell_wall_s, runtime_s) AS x FROM w) WHERE x > 0 GROUP BY ALL"))
def agg_runtime_dist(spark, sf_dir):
    rows = _walls(spark, sf_dir).where("status = 'success'").select("engine", "mode", F.coalesce("cell_wall_s", "runtime_s").alias("x")).where("x > 0")
    return rounded(reports.quartiles(rows, ["engine", "mode"], "x"))


@query("agg_scalability_cells", _sql("SELECT scenario, engine, mode, round(avg(runtime_s), 4) AS runtime, round(avg(trip_count), 4) AS trips FROM runs WHERE status = 'success' AND runtime_s <> 0 AND trip_count <> 0 GROUP BY ALL"))
def agg_scalability_cells(spark, sf_dir):
    good = _ok(spark, sf_dir).where("runtime_s <> 0 AND trip_count <> 0")
    return rounded(good.groupBy(*CELL).agg(F.avg("runtime_s").alias("runtime"), F.avg("trip_count").alias("trips")))


#: Scenarios so fine that a cell has few runs: thin and failed cells occur.
_FINE = "scenario || '_' || seed || '_' || trip_count % 2000"


def _by_seed(rows):
    return rows.withColumn("scenario", F.concat_ws("_", "scenario", "seed", F.col("trip_count") % 2000))


_SEEDED = f"WITH {views.SQL['runs'].replace('runs AS', 'all_runs AS')}, runs AS (SELECT * REPLACE ({_FINE} AS scenario) FROM all_runs), {_CELLS} "


def _thin(spark, sf_dir):
    return statistics.cell_stats(_by_seed(_runs(spark, sf_dir)))


@query("flt_thin_cells", _SEEDED + "SELECT scenario, engine, mode, successes FROM cells WHERE successes > 0 AND successes < 3")
def flt_thin_cells(spark, sf_dir):
    return _thin(spark, sf_dir).where("successes > 0 AND successes < 3").select(*CELL, "successes")


@query("flt_failed_cells", _SEEDED + "SELECT scenario, engine, mode, runs FROM cells WHERE runs > 0 AND successes = 0")
def flt_failed_cells(spark, sf_dir):
    return _thin(spark, sf_dir).where("runs > 0 AND successes = 0").select(*CELL, "runs")


@query(
    "val_coverage",
    _SEEDED + "SELECT scenario, engine, mode, 'thin' AS finding FROM cells WHERE successes > 0 AND successes < 3 UNION ALL SELECT scenario, engine, mode, 'failed' FROM cells WHERE successes = 0 "
    "UNION ALL (SELECT s.scenario, c.engine, c.mode, 'absent' FROM (SELECT DISTINCT scenario FROM cells) s, (SELECT DISTINCT engine, mode FROM cells) c EXCEPT SELECT scenario, engine, mode, 'absent' FROM cells)",
)
def val_coverage(spark, sf_dir):
    cells = _thin(spark, sf_dir)
    named = lambda df, name: df.select(*CELL, F.lit(name).alias("finding"))
    thin, failed = cells.where("successes > 0 AND successes < 3"), cells.where("runs > 0 AND successes = 0")
    return named(thin, "thin").union(named(failed, "failed")).union(named(statistics.coverage_gap(cells), "absent"))


@query("flt_positive_tt", _sql("SELECT scenario, engine, mode, count(*) AS n, round(avg(tt_mean), 4) AS mean_tt FROM runs WHERE status = 'success' AND tt_mean > 0 GROUP BY ALL"))
def flt_positive_tt(spark, sf_dir):
    return rounded(_ok(spark, sf_dir).where("tt_mean > 0").groupBy(*CELL).agg(F.count("*").alias("n"), F.avg("tt_mean").alias("mean_tt")))


@query("set_diff_cells", _sql(", g AS (SELECT DISTINCT scenario, engine, mode, seed FROM runs) SELECT engine, mode, seed FROM g WHERE scenario = 'N' EXCEPT SELECT engine, mode, seed FROM g WHERE scenario = 'A' AND seed < 5"))
def set_diff_cells(spark, sf_dir):
    cells = _runs(spark, sf_dir).select("scenario", "engine", "mode", "seed").distinct()
    present = cells.where("scenario = 'A' AND seed < 5").drop("scenario")
    return cells.where("scenario = 'N'").drop("scenario").join(present, ["engine", "mode", "seed"], "left_anti")


@query("set_modes_axis", _sql("SELECT s.scenario, e.engine, m.mode FROM (SELECT DISTINCT scenario FROM runs) s, (SELECT DISTINCT engine FROM runs) e, (SELECT DISTINCT mode FROM runs) m WHERE NOT (e.engine = 'F' AND m.mode = 'micro')"))
def set_modes_axis(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    axes = [runs.select(c).distinct() for c in ("scenario", "engine", "mode")]  # names of a report's axes
    return axes[0].crossJoin(axes[1]).crossJoin(axes[2]).where("NOT (engine = 'F' AND mode = 'micro')")


def _files(spark, sf_dir):
    """Cells of several result files; ``file`` is the file's place."""
    return _runs(spark, sf_dir).selectExpr("trip_count % 3 AS file", *CELL, "seed", "trip_count", "runtime_s", "tt_mean")


_KEYS = "scenario, engine, mode, seed"


@query("set_concat_results", _sql("SELECT trip_count % 3 AS file, scenario, engine, mode, count(*) AS n FROM runs GROUP BY ALL"))
def set_concat_results(spark, sf_dir):
    rows = _files(spark, sf_dir)
    files = [rows.where(F.col("file") == k) for k in range(3)]
    return files[0].unionByName(files[1]).unionByName(files[2]).groupBy("file", *CELL).agg(F.count("*").alias("n"))


for _name in ("set_dedup_cells", "win_last_result"):

    @query(_name, _sql(f", r AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY trip_count % 3 DESC, trip_count DESC, runtime_s DESC, tt_mean DESC) AS k FROM runs) SELECT {_KEYS}, trip_count % 3 AS file, trip_count, runtime_s, tt_mean FROM r WHERE k = 1"))
    def _latest(spark, sf_dir):
        return reports.latest(_files(spark, sf_dir), [*CELL, "seed"], "file", "trip_count", "runtime_s", "tt_mean")


@query("win_scenario_break", _sql(", c AS (SELECT scenario, engine, mode, count(*) AS runs FROM runs GROUP BY ALL) SELECT *, CAST(row_number() OVER w AS INTEGER) AS line, coalesce(lag(scenario) OVER w <> scenario, false) AS breaks FROM c WINDOW w AS (ORDER BY scenario, engine, mode)"))
def win_scenario_break(spark, sf_dir):
    return reports.with_breaks(_runs(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("runs")))


@query("srt_cells", _sql("SELECT scenario, engine, mode, count(*) AS runs FROM runs GROUP BY ALL ORDER BY 1, 2, 3"))
def srt_cells(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("runs")).orderBy(*CELL)


@query("srt_by_size", _sql(", c AS (SELECT scenario || '_' || seed || 'k' AS city, engine, mode, CAST(seed AS INTEGER) AS size, count(*) AS runs FROM runs GROUP BY ALL) SELECT * FROM c ORDER BY size, engine, mode"))
def srt_by_size(spark, sf_dir):
    from corridor.functions.identity import size_tier

    rows = _runs(spark, sf_dir).withColumn("city", F.concat("scenario", F.lit("_"), "seed", F.lit("k"))).groupBy("city", "engine", "mode").agg(F.count("*").alias("runs"))
    return rows.withColumn("size", size_tier(F.col("city"))).orderBy("size", "engine", "mode")


@query("srt_purpose", views.with_views("trips", "SELECT purpose, count(*) AS trips, min(CAST(substr(trip_id, 2) AS BIGINT)) AS first_pos FROM trips WHERE purpose IS NOT NULL GROUP BY purpose ORDER BY trips DESC, first_pos"))
def srt_purpose(spark, sf_dir):
    pos = F.substring("trip_id", 2, 20).cast("long")
    return views.trips(spark, sf_dir).where("purpose IS NOT NULL").groupBy("purpose").agg(F.count("*").alias("trips"), F.min(pos).alias("first_pos")).orderBy(F.desc("trips"), "first_pos")


@query(
    "join_micro_meso",
    _sql(
        ", m AS (SELECT scenario, engine, seed, avg(runtime_s) FILTER (mode = 'meso') AS a, avg(runtime_s) FILTER (mode = 'micro') AS b FROM (SELECT * REPLACE ((seed + 1) // 2 AS seed) FROM runs WHERE status = 'success') GROUP BY ALL) "
        "SELECT scenario, engine, seed, round(a, 4) AS meso, round(b, 4) AS micro, round(b / a, 4) AS ratio FROM m WHERE a IS NOT NULL AND b IS NOT NULL"
    ),
)
def join_micro_meso(spark, sf_dir):
    rows = _ok(spark, sf_dir).withColumn("seed", F.floor((F.col("seed") + 1) / 2))
    means = rows.groupBy("scenario", "engine", "seed", "mode").agg(F.avg("runtime_s").alias("x"))
    side = lambda mode: means.where(F.col("mode") == mode).select("scenario", "engine", "seed", F.col("x").alias(mode))
    return rounded(side("meso").join(side("micro"), ["scenario", "engine", "seed"]).withColumn("ratio", reports.ratio(F.col("micro"), F.col("meso"))))


@query(
    "join_compare_pair",
    _sql(
        ", m AS (SELECT scenario, mode, engine, avg(runtime_s) AS runtime, avg(trip_count) AS trips FROM runs WHERE status = 'success' GROUP BY ALL) "
        "SELECT a.scenario, a.mode, round(a.runtime / nullif(b.runtime, 0), 4) AS speedup, round((b.trips / b.runtime) / nullif(a.trips / a.runtime, 0), 4) AS throughput_ratio FROM m a JOIN m b USING (scenario, mode) WHERE a.engine = 'F' AND b.engine = 'O'"
    ),
)
def join_compare_pair(spark, sf_dir):
    means = _ok(spark, sf_dir).groupBy("scenario", "mode", "engine").agg(F.avg("runtime_s").alias("runtime"), F.avg("trip_count").alias("trips"))
    side = lambda e, n: means.where(F.col("engine") == e).select("scenario", "mode", F.col("runtime").alias(f"{n}_runtime"), (F.col("trips") / F.col("runtime")).alias(f"{n}_rate"))
    both = side("F", "a").join(side("O", "b"), ["scenario", "mode"])
    return rounded(both.select("scenario", "mode", reports.ratio(F.col("a_runtime"), F.col("b_runtime")).alias("speedup"), reports.ratio(F.col("b_rate"), F.col("a_rate")).alias("throughput_ratio")))


#: Feasibility reports: one a (scenario, engine), of lineitem's groups; one scenario drifts in a count and one in its ids alone.
_REPORTS = [
    "CAST(l_suppkey % 10 AS BIGINT) AS scenario",
    "l_linestatus AS engine",
    "CASE WHEN l_suppkey % 10 = 3 AND l_linestatus = 'F' THEN 1 ELSE 0 END AS drift",
    "CASE WHEN l_suppkey % 10 = 4 AND l_linestatus = 'F' THEN 'x' ELSE 'y' END AS skipped",
]


def _feasibility(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").selectExpr(*_REPORTS).where("NOT (scenario = 5 AND engine = 'F')")
    return rows.groupBy("scenario", "engine").agg(F.max("drift").alias("feasible_trips"), F.collect_set("skipped").alias("skipped_ids"))


_FEAS = f"WITH q AS (SELECT {', '.join(_REPORTS)} FROM lineitem), fr AS (SELECT scenario, engine, max(drift) AS feasible_trips, list_sort(list(DISTINCT skipped)) AS skipped_ids FROM q WHERE NOT (scenario = 5 AND engine = 'F') GROUP BY ALL) "


@query("join_report_q1", _FEAS + "SELECT scenario, count(*) AS reports, CASE WHEN count(*) < 2 THEN 'N/A' WHEN count(DISTINCT feasible_trips) = 1 AND count(DISTINCT skipped_ids) = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM fr GROUP BY scenario")
def join_report_q1(spark, sf_dir):
    found = reports.same_everywhere(_feasibility(spark, sf_dir), "scenario", ["feasible_trips"], "skipped_ids")
    return found.select("scenario", "reports", F.when(F.col("reports") < 2, "N/A").when(F.col("counts_same") & F.col("ids_same"), "PASS").otherwise("FAIL").alias("verdict"))


@query("join_q1_scorecard", _FEAS + "SELECT scenario, CASE WHEN count(*) < 2 THEN 'N/A (single engine)' WHEN count(DISTINCT feasible_trips) = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM fr GROUP BY scenario")
def join_q1_scorecard(spark, sf_dir):
    found = reports.same_everywhere(_feasibility(spark, sf_dir), "scenario", ["feasible_trips"])
    return found.select("scenario", F.when(F.col("reports") < 2, "N/A (single engine)").when(F.col("counts_same"), "PASS").otherwise("FAIL").alias("verdict"))


@query("set_equal_ids", _FEAS + "SELECT scenario, count(DISTINCT skipped_ids) = 1 AS same FROM fr GROUP BY scenario")
def set_equal_ids(spark, sf_dir):
    return reports.same_everywhere(_feasibility(spark, sf_dir), "scenario", ["feasible_trips"], "skipped_ids").select("scenario", F.col("ids_same").alias("same"))


@query("join_feas_reports", _sql("SELECT scenario, engine, mode, min(seed) AS seed, arg_min(n, seed) AS n FROM (SELECT scenario, engine, mode, seed, count(*) AS n FROM runs WHERE seed <> 1 GROUP BY ALL) GROUP BY ALL"))
def join_feas_reports(spark, sf_dir):
    by = _runs(spark, sf_dir).where("seed <> 1").groupBy(*CELL, "seed").agg(F.count("*").alias("n"))
    return by.groupBy(*CELL).agg(F.min("seed").alias("seed"), F.min_by("n", "seed").alias("n"))


@query(
    "val_overall",
    _sql(
        _SCORE + ", t AS (SELECT mode, count(*) AS total, count(*) FILTER (status <> 'success') AS failed FROM runs WHERE scenario <> 'A' GROUP BY mode), l AS (SELECT mode, coalesce(bool_or(r < 0.3), false) AS low FROM s GROUP BY mode) "
        "SELECT mode, CASE WHEN mode = 'micro' THEN 'FAIL — feasibility verdict drift across engines' WHEN low THEN 'WARN — at least one cell has R < 0.80' WHEN failed > 0 THEN 'WARN — ' || failed || '/' || total || ' cell(s) failed' ELSE 'PASS' END AS verdict FROM t JOIN l USING (mode)"
    ),
)
def val_overall(spark, sf_dir):
    total = _runs(spark, sf_dir).where("scenario <> 'A'").groupBy("mode").agg(F.count("*").alias("total"), F.count(F.when(F.col("status") != "success", 1)).alias("failed"))
    low = reports.unclamped_index(_ok(spark, sf_dir), CELL, "tt_mean").groupBy("mode").agg(F.coalesce(F.bool_or(F.col("r") < 0.3), F.lit(False)).alias("low"))
    return total.join(low, "mode").select("mode", labels.overall_verdict(F.col("mode") == "micro", F.col("low"), F.col("failed"), F.col("total")).alias("verdict"))


@query("val_runconfig", _sql("SELECT DISTINCT seed, CASE WHEN seed - 3 < 1 THEN 'repeats' WHEN seed * 100 > 600 THEN 'timeout' END AS rule FROM runs WHERE seed - 3 < 1 OR seed * 100 > 600"))
def val_runconfig(spark, sf_dir):
    config = _runs(spark, sf_dir).select("seed", (F.col("seed") - 3).alias("repeats"), (600 - F.col("seed") * 100).alias("timeout")).distinct()
    rule = F.when(F.col("repeats") < 1, "repeats").when(F.col("timeout") < 0, "timeout")
    return config.select("seed", rule.alias("rule")).where("rule IS NOT NULL")


@query("gen_seeds", _sql("SELECT DISTINCT scenario, unnest([42, 43, 44, 45, 46]) AS seed FROM runs"))
def gen_seeds(spark, sf_dir):
    return _runs(spark, sf_dir).select("scenario").distinct().select("scenario", F.explode(F.sequence(F.lit(42), F.lit(46))).alias("seed"))


@query("agg_feasible_fraction", views.with_views("trips", "SELECT mode, round(coalesce(count(*) FILTER (destination IS NOT NULL AND origin <> destination) / nullif(count(*), 0), 1.0), 6) AS fraction FROM trips GROUP BY mode"))
def agg_feasible_fraction(spark, sf_dir):
    good = F.count(F.when(F.col("destination").isNotNull() & (F.col("origin") != F.col("destination")), 1))
    return views.trips(spark, sf_dir).groupBy("mode").agg(numbers.rounded(F.coalesce(F.try_divide(good, F.count("*")), F.lit(1.0)), 6).alias("fraction"))


@query("agg_mean_skipnull", _wall_sql("SELECT scenario, mode, seed, round(avg(cell_wall_s), 4) AS mean FROM w GROUP BY ALL"))
def agg_mean_skipnull(spark, sf_dir):
    return rounded(_walls(spark, sf_dir).where("status = 'success'").groupBy("scenario", "mode", "seed").agg(F.avg("cell_wall_s").alias("mean")))


@query("agg_engines_present", _sql("SELECT scenario, array_to_string(list_sort(list(DISTINCT engine)), ' ') AS engines FROM runs WHERE trip_count > 0 GROUP BY scenario"))
def agg_engines_present(spark, sf_dir):
    return _runs(spark, sf_dir).where("trip_count > 0").groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_set("engine")), " ").alias("engines"))


@query("topk_pick_cell", _sql("SELECT scenario, arg_min(engine, (engine <> 'O', engine, mode, seed)) AS engine, arg_min(mode, (engine <> 'O', engine, mode, seed)) AS mode, arg_min(seed, (engine <> 'O', engine, mode, seed)) AS seed FROM runs GROUP BY scenario"))
def topk_pick_cell(spark, sf_dir):
    best = F.min(F.struct((F.col("engine") != "O").alias("other"), "engine", "mode", "seed"))
    return _runs(spark, sf_dir).groupBy("scenario").agg(best.alias("b")).select("scenario", "b.engine", "b.mode", "b.seed")


@query("topk_first_artifact", _sql("SELECT scenario, engine, min(seed) AS seed FROM runs WHERE tt_mean > 0 AND seed > 2 GROUP BY ALL"))
def topk_first_artifact(spark, sf_dir):
    return _runs(spark, sf_dir).where("tt_mean > 0 AND seed > 2").groupBy("scenario", "engine").agg(F.min("seed").alias("seed"))
