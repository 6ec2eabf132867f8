"""Rounding of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int) -> Column:
    """``x`` rounded to decimal places in binary arithmetic, halves away from zero, as DuckDB does; ``F.round`` works on the shortest decimal text and differs where the product falls on a half."""
    x = F.col(x) if isinstance(x, str) else x
    scaled = x * F.lit(10.0**places)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**places)).otherwise(x)
