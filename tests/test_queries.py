"""The registered queries against their SQL in DuckDB."""

import duckdb
import pytest

from corridor import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The same search of paths as gr_bfs_sumo; the driver runs it.
SAME_SEARCH = {"topk_unroutable"}


@pytest.mark.parametrize("name", sorted(set(registry.oracles()) - SAME_SEARCH))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    own, other = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracles()[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(own) == rows(other)
