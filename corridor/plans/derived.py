"""Inputs of the scalar queries: expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corridor.session import table

_TWO = "lpad(CAST({x} AS STRING), 2, '0')"
_CLASS = (
    "CASE {k} % 9 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'service' "
    "WHEN 5 THEN 'primary_link' WHEN 6 THEN 'track' WHEN 7 THEN 'unheard_of' ELSE 'secondary' END"
)

#: Name -> (table, columns).
FRAMES: dict[str, tuple[str, list[str]]] = {
    "clock": (
        "events",
        [
            "event_id",
            "CASE event_id % 7 WHEN 0 THEN 'garbage' WHEN 1 THEN NULL WHEN 2 THEN '1:2' ELSE "
            + " || ':' || ".join(_TWO.format(x=x) for x in ("event_id % 24", "event_id % 60", "event_id % 59"))
            + " || '.5' END AS hms",
            "CAST((event_id * 37) % 400000 - 2000 AS BIGINT) AS s",
        ],
    ),
    "tags": (
        "part",
        [
            "CAST(p_partkey AS BIGINT) AS id",
            "CASE p_partkey % 8 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN '80 km/h' WHEN 3 THEN 'none' WHEN 4 THEN NULL WHEN 5 THEN '25 MPH' WHEN 6 THEN ' 45 ' ELSE '' END AS maxspeed",
            "CASE p_partkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '3;2' WHEN 2 THEN NULL WHEN 3 THEN ' 4 ' ELSE '2.5' END AS lanes",
            _CLASS.format(k="p_partkey") + " AS road",
            f"{_CLASS.format(k='p_partkey')} || ',' || {_CLASS.format(k='(p_partkey + 3)')} || ',' || {_CLASS.format(k='(p_partkey * 7)')} AS roads",
            "CASE p_partkey % 6 WHEN 0 THEN '[12, 7,x]' WHEN 1 THEN '99' WHEN 2 THEN NULL WHEN 3 THEN 'bad' WHEN 4 THEN '[]' ELSE '[5]' END AS ways",
            "CASE p_partkey % 6 WHEN 0 THEN 'School:' WHEN 1 THEN 'house:school' WHEN 2 THEN NULL WHEN 3 THEN ' university ' WHEN 4 THEN 'college:x' ELSE 'shop' END AS kind",
            "CAST(p_partkey % 14 AS INT) AS code",
            "CAST(p_partkey % 150 AS INT) AS minutes",
            "CAST(p_retailprice AS DOUBLE) AS price",
        ],
    ),
    "named_runs": (
        "orders",
        [
            "CAST(o_orderkey AS BIGINT) AS id",
            "CASE o_orderkey % 4 WHEN 0 THEN 'chicago_1k' WHEN 1 THEN '' ELSE NULL END AS scenario",
            "CASE o_orderkey % 3 WHEN 0 THEN 'sumo' ELSE NULL END AS engine",
            "CASE o_orderkey % 5 WHEN 0 THEN 'microscopic' WHEN 1 THEN 'meso' ELSE NULL END AS mode",
            "CASE o_orderkey % 9 WHEN 0 THEN 'chicago_1k_sumo_meso' WHEN 1 THEN 'nyc_10k_car_matsim' WHEN 2 THEN 'la_50k_dtalite_micro' WHEN 3 THEN 'sumoton_200k' "
            "WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'x_matsim_meso_sumo' WHEN 7 THEN 'micro_5k_sumo' ELSE 'plain' END AS scenario_id",
            "CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'NaN?' WHEN 2 THEN NULL ELSE '7' END AS loose",
            "CAST(o_orderkey % 3000000 * 1000 AS BIGINT) AS trips",
        ],
    ),
    "readings": (
        "orders",
        [
            "CAST(o_orderkey AS BIGINT) AS id",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS r",
            "CAST(o_orderkey % 37 AS DOUBLE) / 2 AS geh",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) / 8 END AS critical",
            "CAST(o_orderkey % 9 AS DOUBLE) / 16 AS d",
            "CAST(o_orderkey % 40 AS INT) AS n",
            "CAST(o_totalprice AS DOUBLE) AS x",
            "CAST(o_custkey AS DOUBLE) AS y",
        ],
    ),
    "boxes": (
        "customer",
        [
            "CAST(c_custkey AS BIGINT) AS id",
            "CAST(c_custkey % 120 AS DOUBLE) - 60 AS lat",
            "CAST(c_custkey % 300 AS DOUBLE) - 150 AS lon",
            "CAST(c_custkey % 17 AS DOUBLE) + 1 AS radius",
        ],
    ),
    "link_speeds": (
        "lineitem",
        [
            "l_linestatus AS engine",
            "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS STRING) ELSE 'l' || CAST(l_partkey AS STRING) END AS link_id",
            "CAST(l_quantity AS DOUBLE) - 5 AS volume",
            "CAST(l_extendedprice AS DOUBLE) / 1000 AS mean_kmh",
            "CASE WHEN l_linenumber = 3 THEN 0.0 ELSE CAST(l_partkey % 90 AS DOUBLE) END AS free_kmh",
        ],
    ),
    "errors": (
        "orders",
        [
            "CAST(o_orderkey AS BIGINT) AS id",
            "CASE o_orderkey % 7 WHEN 0 THEN 'Conversion failed: netconvert failed: Warning: Ambiguity in turnarounds at junction ' || CAST(o_orderkey AS STRING) || chr(10) || 'Warning: more' || chr(10) || chr(10) || 'and more' "
            "WHEN 1 THEN NULL WHEN 2 THEN '   ' WHEN 3 THEN 'Error: Error: ' || o_orderpriority || ' ' || o_orderstatus || ' said a thing that runs far beyond what a single row of any table could ever show to a reader' "
            "WHEN 4 THEN 'short' WHEN 5 THEN 'Warning: Error: nested' ELSE o_orderstatus || 'oneverylongwordoneverylongwordoneverylongwordoneverylongwordoneverylongwordoneverylongword' END AS error",
        ],
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = FRAMES[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def sql(name: str, select: str) -> str:
    """DuckDB SQL over the frame ``f``."""
    source, columns = FRAMES[name]
    return f"WITH f AS (SELECT {', '.join(columns)} FROM {source}) {select}"
