"""Rounding as DuckDB does it."""

import math

import duckdb
from pyspark.sql import functions as F

from corridor.functions import numbers
from corridor.operators import fidelity


def test_rounding_equals_duckdb(spark):
    pairs = [(16.5, 541406.0), (0.5, 3.0), (0.0, 3.0)]  # of the first, the six-digit product falls on a half from below
    found = spark.createDataFrame(pairs, "a double, b double").select(numbers.rounded(fidelity.geh(F.col("a"), F.col("b")), 6)).collect()
    wanted = [duckdb.sql(f"SELECT round(sqrt(2 * ({b}::DOUBLE - {a}::DOUBLE) * ({b}::DOUBLE - {a}::DOUBLE) / ({b}::DOUBLE + {a}::DOUBLE)), 6)").fetchall()[0][0] for a, b in pairs[:2]]
    assert [r[0] for r in found] == [*wanted, math.inf] and wanted[0] == 1040.53496
    odd = spark.createDataFrame([(None,), (1e305,), (-2.5,), (math.nan,)], "x double").select(numbers.rounded("x", 6), numbers.rounded("x", 0)).collect()
    assert odd[0][0] is None and odd[1][0] == 1e305 and odd[2][1] == -3.0 and math.isnan(odd[3][0])
