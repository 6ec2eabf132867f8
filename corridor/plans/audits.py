"""Fairness audits of all cells, and the scorecard of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import views
from corridor.operators import audit, statistics
from corridor.plans.files import _bundle_files, _document, _fixed
from corridor.plans.statistics import _CELLS
from corridor.registry import query
from corridor.sinks import files as out

#: Cells of the orders: a scenario a priority, every engine with the same trips but for some that deviate.
_CELL = "o_orderpriority AS scenario, CASE WHEN o_custkey % 2 = 0 THEN 'meso' ELSE 'micro' END AS mode, CAST(o_custkey % 7 AS INT) AS seed"
_REPORTS = (
    f"od AS (SELECT {_CELL}, o_orderkey AS k FROM orders), tt AS (SELECT scenario, mode, seed, count(*) AS n, count(*) FILTER (k % 7 <> 0) AS f, count(*) FILTER (k % 7 = 0) AS s, CAST(coalesce(sum(('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 8))::BIGINT) FILTER (k % 7 = 0), 0) AS BIGINT) AS h FROM od GROUP BY ALL), "
    "eg AS (SELECT tt.*, unnest(['sumo', 'matsim', 'dtalite']) AS engine FROM tt), "
    "rp AS (SELECT scenario, mode, seed, engine, CASE WHEN seed = 3 AND engine = 'matsim' THEN f + 1 ELSE f END AS feasible_trips, n AS total_trips, 100 AS scc_nodes, CASE WHEN seed = 5 AND engine <> 'sumo' THEN NULL WHEN seed = 5 THEN 0 ELSE 200 END AS scc_links, s AS skipped_outside_scc, s AS skipped_n, CASE WHEN seed = 4 AND engine = 'dtalite' THEN h + 1 ELSE h END AS skipped_sum FROM eg WHERE NOT (seed = 6 AND engine <> 'sumo')) "
)


def _frames(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").selectExpr(*_CELL.split(", ", 1)[:1], _CELL.split(", ")[1], "CAST(o_custkey % 7 AS INT) AS seed", "o_orderkey AS k")
    skipped = F.col("k") % 7 == 0
    by = orders.groupBy(*audit.CELL).agg(F.count("*").alias("n"), F.count(F.when(~skipped, 1)).alias("f"), F.count(F.when(skipped, 1)).alias("s"), F.coalesce(F.sum(F.when(skipped, audit.skipped_sum(F.col("k")))), F.lit(0)).alias("h"))
    each = by.withColumn("engine", F.explode(F.array(*map(F.lit, ("sumo", "matsim", "dtalite")))))
    reports = each.where("NOT (seed = 6 AND engine <> 'sumo')").selectExpr(
        *audit.CELL, "engine", "CASE WHEN seed = 3 AND engine = 'matsim' THEN f + 1 ELSE f END AS feasible_trips", "n AS total_trips", "100 AS scc_nodes", "CASE WHEN seed = 5 AND engine <> 'sumo' THEN NULL WHEN seed = 5 THEN 0 ELSE 200 END AS scc_links",
        "s AS skipped_outside_scc", "0 AS skipped_unknown_nodes", "CAST(NULL AS INT) AS skipped_missing_fields", "0 AS skipped_unsupported_mode", "s AS skipped_n", "CASE WHEN seed = 4 AND engine = 'dtalite' THEN h + 1 ELSE h END AS skipped_sum",
    )
    networks = each.selectExpr(*audit.CELL, "engine", "CASE WHEN seed = 2 AND engine = 'dtalite' THEN 99 ELSE 100 END AS nodes", "200 AS links")
    simulated = each.selectExpr(*audit.CELL, "engine", "CASE WHEN seed = 1 AND engine = 'sumo' THEN f - 1 ELSE f END AS trips")
    times = orders.withColumn("engine", F.when(F.col("k") % 3 == 0, "sumo").when(F.col("k") % 3 == 1, "matsim").otherwise("dtalite")).select(*audit.CELL, "engine", (F.col("k") % 1009 + 1).cast("double").alias("tt"))
    purpose = F.expr("CASE k % 7 WHEN 0 THEN 'HBW_AM' WHEN 1 THEN 'HBW_PM' WHEN 2 THEN 'HBSchool_AM' WHEN 3 THEN 'HBSchool_PM' WHEN 4 THEN 'HBW_AM_chained' WHEN 5 THEN 'HBW_PM_chained' ELSE ' ' END")
    return reports, networks, simulated, times, orders.select("scenario", purpose.alias("purpose"))


_Q1 = "q1 AS (SELECT scenario, mode, seed, string_agg(engine, ', ' ORDER BY engine) AS engines, CASE WHEN count(DISTINCT (feasible_trips, total_trips, scc_nodes, coalesce(scc_links, 0), skipped_outside_scc, skipped_n, skipped_sum)) > 1 THEN 'FAIL' WHEN count(*) > count(scc_links) THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) AS n FROM rp GROUP BY ALL HAVING count(*) >= 2)"
_AUDIT = (
    f"WITH {_REPORTS}, {_Q1}, tm AS (SELECT scenario, mode, seed, CASE k % 3 WHEN 0 THEN 'sumo' WHEN 1 THEN 'matsim' ELSE 'dtalite' END AS engine, k % 1009 + 1.0::DOUBLE AS t FROM od), me AS (SELECT scenario, mode, seed, engine, avg(t) AS m, list_sort(list(t))[1 + CAST(floor((count(*) - 1) * 95 / 100) AS BIGINT)] AS p FROM tm GROUP BY ALL), "
    "dm AS (SELECT scenario, count(*) FILTER (k % 7 IN (0, 2, 4)) AS am, count(*) FILTER (k % 7 IN (1, 3, 5)) AS pm, count(*) FILTER (k % 7 BETWEEN 2 AND 5) AS ch FROM od GROUP BY 1) "
    "SELECT scenario, mode, seed, question, subject, verdict, round(CAST(value AS DOUBLE), 4) AS value FROM ("
    "SELECT scenario, mode, seed, 'Q1' AS question, engines AS subject, verdict, CAST(n AS DOUBLE) AS value FROM q1 UNION ALL SELECT scenario, mode, seed, 'Q2', 'nodes', CASE WHEN seed = 2 THEN 'WARN' ELSE 'PASS' END, 100 FROM tt "
    "UNION ALL SELECT scenario, mode, seed, 'Q3', engine, CASE WHEN t = coalesce(feasible_trips, 0) THEN 'PASS' ELSE 'WARN' END, t FROM (SELECT *, CASE WHEN seed = 1 AND engine = 'sumo' THEN f - 1 ELSE f END AS t FROM eg) LEFT JOIN rp USING (scenario, mode, seed, engine) "
    "UNION ALL SELECT scenario, mode, seed, 'Q4', engine || ' mean', 'INFO', m FROM me UNION ALL SELECT scenario, mode, seed, 'Q4', engine || ' p95', 'INFO', p FROM me "
    "UNION ALL SELECT scenario, mode, seed, 'Q4', a.engine || '/' || b.engine, 'INFO', a.m / b.m FROM me a JOIN me b USING (scenario, mode, seed) WHERE (a.engine, b.engine) IN (('dtalite', 'matsim'), ('sumo', 'matsim'), ('sumo', 'dtalite')) "
    "UNION ALL SELECT scenario, mode, seed, 'Q5', unnest(['am', 'pm', 'chain_legs']), 'INFO', unnest([am, pm, ch]) FROM (SELECT DISTINCT scenario, mode, seed FROM rp) JOIN dm USING (scenario))"
)


@query("val_audit", _AUDIT)
def val_audit(spark, sf_dir):
    return statistics.rounded(audit.audit(*_frames(spark, sf_dir)))


def _level(r):
    return f"CASE WHEN {r} IS NULL OR isnan({r}) THEN '—' WHEN {r} >= 0.99 THEN 'EXCELLENT' WHEN {r} >= 0.95 THEN 'GOOD' WHEN {r} >= 0.80 THEN 'ACCEPTABLE' ELSE 'POOR' END"


_CARD = (
    f"WITH {views.SQL['runs']}, {_CELLS}, {_REPORTS}, {_Q1}, fa AS (SELECT scenario, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS verdict, max(engines) AS engines FROM q1 GROUP BY 1), "
    "b AS (SELECT o_custkey % 50 AS bundle, CASE o_orderkey % 5 WHEN 0 THEN 'network.xml' WHEN 1 THEN 'demand.csv' WHEN 2 THEN 'config.xml' WHEN 3 THEN 'signals.xml' ELSE 'notes.txt' END AS name, min(o_orderpriority) AS content FROM orders GROUP BY ALL), "
    "ca AS (SELECT * FROM cells WHERE successes > 0), wh AS (SELECT (SELECT avg(r) FROM ca WHERE n_tt >= 2 AND NOT isnan(r)) AS r, (SELECT coalesce(bool_or(n_tt >= 2 AND NOT isnan(r) AND r < 0.8), false) FROM ca) AS low, CAST((SELECT sum(runs) FROM cells) AS BIGINT) AS runs, CAST((SELECT sum(successes) FROM cells) AS BIGINT) AS ok, (SELECT bool_or(verdict = 'FAIL') FROM fa) AS drift) "
    + _fixed("# Reproducibility Scorecard — `benchmark`", "", "## Provenance", "", "", "## Cross-engine fairness", "", "| Scenario | Q1 verdict | Engines reporting |", "|---|---|---|", "", "## Reproducibility", "", "| Scenario | Engine | Mode | N reps | mean TT (s) | σ (s) | R | Verdict |", "|---|---|---|---:|---:|---:|---:|---|")
    + "UNION ALL SELECT unnest(['**Overall verdict: `' || CASE WHEN drift THEN 'FAIL — feasibility verdict drift across engines' WHEN low THEN 'WARN — at least one cell has R < 0.80' WHEN runs > ok THEN 'WARN — ' || (runs - ok) || '/' || runs || ' cell(s) failed' ELSE 'PASS' END || '`**', '', "
    f"'', '**Overall R (mean across cells with N≥2):** `' || printf('%.4f', r) || '` (' || {_level('r')} || ')', '', '## Run summary', '', '- **Total runs:** ' || runs, '- **Successful:** ' || ok, '- **Failed:** ' || (runs - ok), '', '### Failed runs', '', '| Scenario | Engine | Mode | Seed | Error |', '|---|---|---|---:|---|']) FROM wh "
    "UNION ALL SELECT DISTINCT '- `b' || bundle || '`' FROM b WHERE name <> 'notes.txt' UNION ALL SELECT '  - `' || name || '` — `' || substr(sha256(content), 1, 32) || '…`' FROM b WHERE name <> 'notes.txt' "
    "UNION ALL SELECT '| `' || scenario || '` | `' || verdict || '` | ' || engines || ' |' FROM fa "
    f"UNION ALL SELECT '| `' || scenario || '` | `' || engine || '` | `' || mode || '` | ' || n_tt || ' | ' || printf('%.2f', mean_tt) || ' | ' || printf('%.2f', std_tt) || ' | ' || CASE WHEN isnan(r) THEN '—' ELSE printf('%.4f', r) END || ' | ' || {_level('r')} || ' |' FROM ca "
    "UNION ALL SELECT '| `' || scenario || '` | `' || engine || '` | `' || mode || '` | ' || seed || ' | run took ' || CAST(runtime_s AS VARCHAR) || ' s |' FROM runs WHERE status <> 'success'"
)


@_document("snk_scorecard_md", _CARD)
def snk_scorecard_md(spark, sf_dir):
    runs = views.runs(spark, sf_dir)
    failed = runs.where("status <> 'success'").select("scenario", "engine", "mode", "seed", F.concat(F.lit("run took "), F.col("runtime_s").cast("string"), F.lit(" s\nsecond line")).alias("error"))
    q1 = audit.feasibility(_frames(spark, sf_dir)[0])
    fairness = q1.groupBy("scenario").agg(F.when(F.bool_or(F.col("verdict") == "FAIL"), "FAIL").otherwise("PASS").alias("verdict"), F.max("subject").alias("engines"))
    hashes = _bundle_files(spark, sf_dir).where("name <> 'notes.txt'").select(F.concat(F.lit("b"), "bundle").alias("scenario"), "name", F.sha2("content", 256).alias("sha256"))
    return out.scorecard_md("benchmark", hashes, fairness, statistics.cell_stats(runs), failed)
