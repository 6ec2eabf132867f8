"""Fairness of a benchmark: five questions for every (scenario, mode, seed), as rows of one table.

Findings are ``scenario, mode, seed, question, subject, verdict, value``. Q1: do all engines report
the same feasible trips? Q2: do they emit as many nodes? Q3: does each simulate the trips that it
reports? Q4: their travel times, and the ratios of their means. Q5: what the demand is made of.
Sets of skipped trips are compared by their number and the sum of their hashes, so that no list
of ids is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.operators.statistics import floor_percentile

CELL = ["scenario", "mode", "seed"]
OUT = [*CELL, "question", "subject", "verdict", "value"]
#: What a report must hold, what is compared besides, and the pairs of engines whose mean times are.
CORE = ("feasible_trips", "total_trips", "scc_nodes", "scc_links")
SKIPPED = ("skipped_outside_scc", "skipped_unknown_nodes", "skipped_missing_fields", "skipped_unsupported_mode")
PAIRS = (("dtalite", "matsim"), ("sumo", "matsim"), ("sumo", "dtalite"))


def _row(rows: DataFrame, question: str, subject, verdict, value) -> DataFrame:
    wrap = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(*CELL, F.lit(question).alias("question"), wrap(subject).alias("subject"), wrap(verdict).alias("verdict"), value.cast("double").alias("value"))


def skipped_sum(id_):
    """A row's share of the sum by which sets of ids are compared."""
    return F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("bigint")


def feasibility(reports: DataFrame) -> DataFrame:
    """Q1 from reports (``engine``, the compared numbers, ``skipped_n, skipped_sum``): one row a cell that two engines report."""
    keys = [*CORE, *SKIPPED, "skipped_n", "skipped_sum"]
    zero = lambda k: F.coalesce(F.col(k), F.lit(0))
    same = reduce(lambda a, b: a & b, (F.min(zero(k)) == F.max(zero(k)) for k in keys))
    absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in CORE))
    by = reports.groupBy(*CELL).agg(same.alias("same"), F.count("*").alias("n"), F.bool_or(absent).alias("absent"), F.array_join(F.array_sort(F.collect_list("engine")), ", ").alias("engines"))
    verdict = F.when(~F.col("same"), "FAIL").when(F.col("absent"), "WARN").otherwise("PASS")
    return _row(by.where("n >= 2"), "Q1", F.col("engines"), verdict, F.col("n"))


def audit(reports: DataFrame, networks: DataFrame, simulated: DataFrame, times: DataFrame, demand: DataFrame) -> DataFrame:
    """All findings, from reports, ``engine, nodes, links`` of networks, ``engine, trips`` simulated, ``engine, tt``, and ``scenario, purpose`` of the demand."""
    n = F.count("*")
    nodes = networks.groupBy(*CELL).agg((F.min("nodes") == F.max("nodes")).alias("same"), n.alias("n"), F.max("nodes").alias("nodes")).where("n >= 2")
    target = reports.select(*CELL, "engine", "feasible_trips")
    sims = simulated.join(target, [*CELL, "engine"], "left").withColumn("target", F.coalesce("feasible_trips", F.lit(0)))
    means = times.groupBy(*CELL, "engine").agg(F.avg("tt").alias("mean"))
    p95 = floor_percentile(times, [*CELL, "engine"], "tt")
    wide = means.groupBy(*CELL).pivot("engine", ["sumo", "matsim", "dtalite"]).agg(F.first("mean"))
    ratios = [_row(wide.where(f"{a} IS NOT NULL AND {b} <> 0"), "Q4", f"{a}/{b}", "INFO", F.col(a) / F.col(b)) for a, b in PAIRS]
    kinds = {"am": F.col("purpose").contains("_AM"), "pm": F.col("purpose").contains("_PM"), "chain_legs": F.col("purpose").endswith("chained") | F.col("purpose").startswith("HBSchool")}
    made = demand.where("trim(coalesce(purpose, '')) <> ''").groupBy("scenario").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()))
    cells = reports.select(*CELL).distinct().join(made, "scenario")
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in kinds)))
    found = [
        feasibility(reports), _row(nodes, "Q2", "nodes", F.when(F.col("same"), "PASS").otherwise("WARN"), F.col("nodes")),
        _row(sims, "Q3", F.col("engine"), F.when(F.col("trips") == F.col("target"), "PASS").otherwise("WARN"), F.col("trips")),
        _row(means, "Q4", F.concat("engine", F.lit(" mean")), "INFO", F.col("mean")), _row(p95, "Q4", F.concat("engine", F.lit(" p95")), "INFO", F.col("p")), *ratios,
        _row(cells.withColumn("x", parts), "Q5", F.col("x.k"), "INFO", F.col("x.v")),
    ]
    return reduce(DataFrame.union, found).select(*OUT)
