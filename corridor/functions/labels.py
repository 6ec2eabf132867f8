"""Readings of statistics as words. Bands are fixed values and differ from report to report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step that ``value`` reaches."""
    out = F
    for least, name in steps:
        out = out.when(value >= least, name)
    return out.otherwise(rest)


def geh_reading(geh: Column) -> Column:
    return F.when(geh < 5, "acceptable").when(geh < 10, "warrants investigation").otherwise("poor fit")


def ks_reading(d: Column, critical: Column) -> Column:
    four = lambda x: F.format_string("%.4f", x)
    similar = F.concat(F.lit("distributions similar (D="), four(d), F.lit(" < critical="), four(critical), F.lit(")"))
    apart = F.concat(F.lit("distributions differ (D="), four(d), F.lit(" >= critical="), four(critical), F.lit(")"))
    return F.when(critical.isNull(), "no test performed").when(d < critical, similar).otherwise(apart)


def scorecard_grade(r: Column) -> Column:
    """The scorecard's bands; null is not graded."""
    return F.when(r.isNull(), "N/A").otherwise(bands(r, [(0.99, "EXCELLENT"), (0.95, "GOOD"), (0.80, "ACCEPTABLE")], "POOR"))


def table_rating(r: Column) -> Column:
    """The result table's bands; NaN is one run alone."""
    return F.when(F.isnan(r), "n/a (N<2)").otherwise(bands(r, [(0.99, "Excellent"), (0.95, "Good"), (0.90, "Acceptable")], "Poor"))


def index_reading(r: Column) -> Column:
    """The six bands of the reproducibility metrics."""
    steps = [(0.99, "excellent (near-deterministic)"), (0.95, "very good"), (0.90, "good"), (0.80, "acceptable"), (0.50, "moderate variability")]
    return bands(r, steps, "poor (high variability)")


def overall_verdict(drift: Column, low_r: Column, failed: Column, total: Column) -> Column:
    """The scorecard's verdict: drift of feasibility first, then a low index, then failed cells."""
    some = F.concat(F.lit("WARN — "), failed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" cell(s) failed"))
    return (
        F.when(drift, "FAIL — feasibility verdict drift across engines")
        .when(low_r, "WARN — at least one cell has R < 0.80")
        .when(failed > 0, some)
        .otherwise("PASS")
    )
