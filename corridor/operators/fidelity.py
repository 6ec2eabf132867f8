"""Agreement of two engines: RMSE, GEH, Kolmogorov-Smirnov."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.operators.ranges import running_sums


def geh(a: Column, b: Column) -> Column:
    """The GEH statistic; infinite where a count is not positive."""
    return F.when((a <= 0) | (b <= 0), F.lit(float("inf"))).otherwise(F.sqrt(2 * (a - b) * (a - b) / (a + b)))


def rmse(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Count and root mean square difference of matched values."""
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))


def geh_batch(counts: DataFrame, key: str, engine: str, value: str, first: str, second: str) -> DataFrame:
    """Links of either engine (absent: 0): mean of finite values and the share below 5 of all."""
    one = counts.where(F.col(engine) == first).select(key, F.col(value).alias("a"))
    two = counts.where(F.col(engine) == second).select(key, F.col(value).alias("b"))
    both = one.join(two, key, "full_outer").select(geh(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("g"))
    finite = F.when(F.col("g") < float("inf"), F.col("g"))
    return both.agg(
        F.count("*").alias("links"),
        F.coalesce(F.avg(finite), F.lit(float("inf"))).alias("mean_geh"),
        (F.avg((F.col("g") < 5).cast("double")) * 100).alias("below_5_pct"),
    )


def ks(values: DataFrame, engine: str, value: str, first: str, second: str) -> DataFrame:
    """Two-sample statistic and its 5 % critical value; ties are counted before the running sums."""
    a, b = (F.sum((F.col(engine) == e).cast("long")) for e in (first, second))
    by = values.groupBy(F.col(value).alias("x")).agg(a.alias("a"), b.alias("b")).where("a + b > 0")
    totals = by.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))  # one row
    run = running_sums(by, [], "x", ["a", "b"]).crossJoin(F.broadcast(totals))
    gap = F.abs(F.col("a_upto") / F.col("n") - F.col("b_upto") / F.col("m"))
    out = run.agg(F.max(gap).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    return out.withColumn("critical", 1.36 * F.sqrt((F.col("n") + F.col("m")) / (F.col("n") * F.col("m"))))
