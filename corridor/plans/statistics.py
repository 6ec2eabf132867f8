"""Queries on run statistics and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import views
from corridor.operators import fidelity, statistics
from corridor.registry import query

#: Written out again: the SQL shares no value with the code it holds.
_T = (
    "[12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, "
    "2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]"
)
_CI = f"CASE WHEN {{n}} < 2 THEN 0.0 WHEN {{n}} <= 31 THEN {_T}[{{n}} - 1]::DOUBLE ELSE 1.96::DOUBLE END * CASE WHEN {{n}} < 2 THEN 0.0 ELSE {{s}} / sqrt({{n}}) END"
_CELLS = f"""cells AS (SELECT *, CASE WHEN n_tt < 2 THEN 'NaN'::DOUBLE WHEN mean_tt = 0 THEN 1.0 ELSE greatest(0.0, 1 - std_tt / mean_tt) END AS r,
  {_CI.format(n='successes', s='std_runtime')} AS ci_runtime, {_CI.format(n='n_tt', s='std_tt')} AS ci_tt FROM (
  SELECT scenario, engine, mode, count(*) AS runs, count(*) FILTER (status = 'success') AS successes,
    coalesce(avg(runtime_s) FILTER (status = 'success'), 0) AS mean_runtime, coalesce(stddev_samp(runtime_s) FILTER (status = 'success'), 0) AS std_runtime,
    coalesce(min(runtime_s) FILTER (status = 'success'), 0) AS min_runtime, coalesce(max(runtime_s) FILTER (status = 'success'), 0) AS max_runtime,
    coalesce(avg(trip_count) FILTER (status = 'success'), 0) AS mean_trips, count(*) FILTER (status = 'success' AND tt_mean > 0) AS n_tt,
    coalesce(avg(tt_mean) FILTER (status = 'success' AND tt_mean > 0), 0) AS mean_tt, coalesce(stddev_samp(tt_mean) FILTER (status = 'success' AND tt_mean > 0), 0) AS std_tt
  FROM runs GROUP BY scenario, engine, mode))"""
_VIEW = views.SQL


@query(
    "agg_cell_stats",
    f"WITH {_VIEW['runs']}, {_CELLS} SELECT scenario, engine, mode, runs, successes, round(mean_runtime, 4) AS mean_runtime, round(std_runtime, 4) AS std_runtime, "
    "round(min_runtime, 4) AS min_runtime, round(max_runtime, 4) AS max_runtime, round(mean_trips, 4) AS mean_trips, n_tt, round(mean_tt, 4) AS mean_tt, "
    "round(std_tt, 4) AS std_tt, round(r, 4) AS r, round(ci_runtime, 4) AS ci_runtime, round(ci_tt, 4) AS ci_tt FROM cells",
)
def agg_cell_stats(spark, sf_dir):
    return statistics.rounded(statistics.cell_stats(views.runs(spark, sf_dir)))


@query(
    "agg_summary_engine",
    f"WITH {_VIEW['runs']}, {_CELLS} SELECT engine, count(*) AS cells, round(avg(mean_runtime), 4) AS mean_runtime, round(avg(mean_tt), 4) AS mean_tt, "
    "round(avg(r) FILTER (successes >= 2 AND NOT isnan(r)), 4) AS mean_r FROM cells WHERE successes > 0 GROUP BY engine",
)
def agg_summary_engine(spark, sf_dir):
    return statistics.rounded(statistics.summary_by_engine(statistics.cell_stats(views.runs(spark, sf_dir))))


@query(
    "agg_repro_index",
    views.with_views(
        "runs",
        "SELECT scenario, engine, mode, count(*) AS n, round(avg(tt_mean), 4) AS mean, round(stddev_samp(tt_mean), 4) AS std, round(min(tt_mean), 4) AS min, "
        "round(max(tt_mean), 4) AS max, round(stddev_samp(tt_mean) / abs(avg(tt_mean)), 4) AS cv, round(greatest(0.0, 1 - stddev_samp(tt_mean) / abs(avg(tt_mean))), 4) AS r "
        "FROM runs WHERE status = 'success' GROUP BY scenario, engine, mode HAVING count(*) >= 2",
    ),
)
def agg_repro_index(spark, sf_dir):
    ok = views.runs(spark, sf_dir).where("status = 'success'")
    return statistics.rounded(statistics.reproducibility_index(ok, ["scenario", "engine", "mode"], "tt_mean"))


_P95 = "SELECT scenario, engine, mode, count(*) AS n, round(list_sort(list(tt_mean))[1 + {i}], 4) AS p FROM runs GROUP BY scenario, engine, mode"


@query("agg_p95", views.with_views("runs", _P95.format(i="CAST(floor((count(*) - 1) * 95 / 100) AS BIGINT)")))
def agg_p95(spark, sf_dir):
    return statistics.rounded(statistics.floor_percentile(views.runs(spark, sf_dir), ["scenario", "engine", "mode"], "tt_mean"))


@query("p95_floor_n", views.with_views("runs", _P95.format(i="CAST(least(floor(count(*) * 95 / 100), count(*) - 1) AS BIGINT)")))
def p95_floor_n(spark, sf_dir):
    return statistics.rounded(statistics.floor_percentile(views.runs(spark, sf_dir), ["scenario", "engine", "mode"], "tt_mean", of_n=True))


@query(
    "agg_weighted_tt",
    "WITH a AS (SELECT l_linestatus AS engine, CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / 1000 * 60 END AS tt, l_tax * 1000 AS dist, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS w FROM lineitem WHERE l_quantity > 0), "
    "p AS (SELECT * FROM a WHERE w > 0), r AS (SELECT engine, tt, sum(w) OVER (PARTITION BY engine ORDER BY tt) AS upto, sum(w) OVER (PARTITION BY engine) AS n FROM p WHERE tt > 0), "
    "q AS (SELECT engine, min(tt) AS p95 FROM r WHERE upto > floor((n - 1) * 95 / 100) GROUP BY engine) "
    "SELECT engine, CAST(sum(w) AS BIGINT) AS trip_count, CAST(coalesce(sum(w) FILTER (tt > 0), 0) AS BIGINT) AS completed, round(sum(tt * w) FILTER (tt > 0) / sum(w) FILTER (tt > 0), 4) AS mean_tt, "
    "round(sum(dist * w) FILTER (tt > 0) / sum(w) FILTER (tt > 0), 4) AS mean_distance, round(coalesce(any_value(p95), 0), 4) AS p95_tt FROM p LEFT JOIN q USING (engine) GROUP BY engine",
)
def agg_weighted_tt(spark, sf_dir):
    tt = F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice") / 1000 * 60)
    agents = views.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("engine"), tt.alias("tt"), (F.col("l_tax") * 1000).alias("distance"), (F.col("l_quantity") / 4).alias("volume"))
    return statistics.rounded(statistics.weighted_trips(agents, ["engine"]))


@query(
    "agg_mode_compare",
    views.with_views(
        "runs",
        ", m AS (SELECT scenario, engine, avg(runtime_s) FILTER (mode = 'meso') AS meso_runtime, avg(runtime_s) FILTER (mode = 'micro') AS micro_runtime, "
        "avg(tt_mean) FILTER (mode = 'meso') AS meso_tt, avg(tt_mean) FILTER (mode = 'micro') AS micro_tt, avg(tt_p95) FILTER (mode = 'meso') AS meso_p95, avg(tt_p95) FILTER (mode = 'micro') AS micro_p95 "
        "FROM runs WHERE status = 'success' GROUP BY scenario, engine) "
        "SELECT scenario, engine, round(meso_runtime, 4) AS meso_runtime, round(micro_runtime, 4) AS micro_runtime, round(meso_tt, 4) AS meso_tt, round(micro_tt, 4) AS micro_tt, "
        "round(meso_p95, 4) AS meso_p95, round(micro_p95, 4) AS micro_p95, round(micro_runtime / nullif(meso_runtime, 0), 4) AS speedup, "
        "round((micro_runtime - meso_runtime) / nullif(meso_runtime, 0) * 100, 4) AS runtime_diff_pct, round((micro_tt - meso_tt) / nullif(meso_tt, 0) * 100, 4) AS tt_diff_pct, "
        "round((micro_p95 - meso_p95) / nullif(meso_p95, 0) * 100, 4) AS p95_diff_pct FROM m WHERE meso_runtime IS NOT NULL AND micro_runtime IS NOT NULL",
    ).replace(" , m AS", ", m AS"),
)
def agg_mode_compare(spark, sf_dir):
    return statistics.rounded(statistics.mode_comparison(views.runs(spark, sf_dir)))


@query(
    "join_speedup",
    views.with_views(
        "runs",
        ", m AS (SELECT scenario, mode, engine, avg(runtime_s) AS runtime FROM runs WHERE status = 'success' GROUP BY ALL) "
        "SELECT o.scenario, o.mode, o.engine, round(b.runtime / nullif(o.runtime, 0), 4) AS speedup FROM m o JOIN m b ON o.scenario = b.scenario AND o.mode = b.mode "
        "WHERE b.engine = 'F' AND o.engine <> 'F'",
    ).replace(" , m AS", ", m AS"),
)
def join_speedup(spark, sf_dir):
    return statistics.rounded(statistics.speedup(views.runs(spark, sf_dir), "F"))


@query(
    "agg_scalability",
    views.with_views(
        "runs",
        "SELECT scenario, engine, mode, round(avg(runtime_s), 4) AS runtime, round(avg(trip_count), 4) AS trips, round(avg(trip_count) / avg(runtime_s), 4) AS trips_per_s, "
        "round(3600 / avg(runtime_s), 4) AS simulated_per_real, round(avg(trip_count) / avg(runtime_s) / 8, 4) AS trips_per_s_core, round(avg(trip_count) / avg(runtime_s) / 150, 4) AS trips_per_s_watt "
        "FROM runs WHERE status = 'success' AND runtime_s > 0 AND trip_count > 0 GROUP BY scenario, engine, mode",
    ),
)
def agg_scalability(spark, sf_dir):
    return statistics.rounded(statistics.scalability(views.runs(spark, sf_dir), simulated_s=3600.0, cores=8, watts=150.0))


#: Runs with a cell that one scenario lacks and one that is never run there.
_GAPS = "NOT (scenario = 'A' AND mode = 'micro' AND engine = 'F') AND NOT (scenario = 'N' AND engine = 'F')"


@query(
    "join_coverage_gap",
    views.with_views(
        "runs",
        f", g AS (SELECT * FROM runs WHERE {_GAPS}) SELECT s.scenario, c.engine, c.mode FROM (SELECT DISTINCT scenario FROM g) s, (SELECT DISTINCT engine, mode FROM g) c EXCEPT SELECT scenario, engine, mode FROM g",
    ).replace(" , g AS", ", g AS"),
)
def join_coverage_gap(spark, sf_dir):
    return statistics.coverage_gap(views.runs(spark, sf_dir).where(_GAPS))


@query(
    "agg_rmse",
    views.with_views(
        "trip_times",
        "SELECT count(*) AS n, round(sqrt(avg(CAST((a.tt - b.tt) * (a.tt - b.tt) AS DOUBLE))), 2) AS rmse FROM trip_times a JOIN trip_times b ON a.trip_id = b.trip_id WHERE a.engine = 'F' AND b.engine = 'O'",
    ),
)
def agg_rmse(spark, sf_dir):
    tt = views.trip_times(spark, sf_dir)
    one = tt.where("engine = 'F'").select("trip_id", F.col("tt").alias("a"))
    return statistics.rounded(fidelity.rmse(one.join(tt.where("engine = 'O'").select("trip_id", F.col("tt").alias("b")), "trip_id"), "a", "b"), 2)


@query(
    "agg_geh_batch",
    views.with_views(
        "link_counts",
        ", j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT * FROM link_counts WHERE engine = 'F') a FULL JOIN (SELECT * FROM link_counts WHERE engine = 'O') b ON a.link = b.link), "
        "g AS (SELECT CASE WHEN x <= 0 OR y <= 0 THEN 'Infinity'::DOUBLE ELSE sqrt(2.0::DOUBLE * (x - y) * (x - y) / (x + y)) END AS g FROM j) "
        "SELECT count(*) AS links, round(coalesce(avg(g) FILTER (g < 'Infinity'::DOUBLE), 'Infinity'::DOUBLE), 4) AS mean_geh, round(avg(CASE WHEN g < 5 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 4) AS below_5_pct FROM g",
    ).replace(" , j AS", ", j AS"),
)
def agg_geh_batch(spark, sf_dir):
    return statistics.rounded(fidelity.geh_batch(views.link_counts(spark, sf_dir), "link", "engine", "n", "F", "O"))


@query(
    "agg_ks",
    views.with_views(
        "trip_times",
        ", x AS (SELECT tt, count(*) FILTER (engine = 'F') AS a, count(*) FILTER (engine = 'O') AS b FROM trip_times GROUP BY tt), "
        "c AS (SELECT sum(a) OVER (ORDER BY tt) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY tt) / sum(b) OVER () AS fb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM x) "
        "SELECT round(max(abs(fa - fb)), 6) AS d, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(1.36::DOUBLE * sqrt((max(n) + max(m)) / (max(n) * max(m))), 6) AS critical FROM c",
    ).replace(" , x AS", ", x AS"),
)
def agg_ks(spark, sf_dir):
    return statistics.rounded(fidelity.ks(views.trip_times(spark, sf_dir), "engine", "tt", "F", "O"), 6)
