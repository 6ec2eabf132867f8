"""Domain tables of transport studies, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.operators.ranges import with_next
from corridor.session import table

#: Vocabularies of modes and purposes.
MODES = ("car", "transit", "bike", "walk")
PURPOSES = ("HBW_AM", "HBW_PM", "HBSchool_AM", "HBSchool_PM", "HBW_AM_chained", "HBW_PM_chained")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a simulation run."""
    tt = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("scenario"),
        F.col("l_linestatus").alias("engine"),
        F.when(F.col("l_linenumber") % 2 == 0, "meso").otherwise("micro").alias("mode"),
        F.col("l_linenumber").cast("long").alias("seed"),
        F.when(F.col("l_tax") > 0.07, "failed").otherwise("success").alias("status"),
        F.col("l_quantity").cast("double").alias("runtime_s"),
        tt.alias("tt_mean"),
        (tt * 1.2).alias("tt_p95"),
        F.col("l_partkey").cast("long").alias("trip_count"),
    )


def trip_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``engine, trip_id, tt``: a trip's greatest travel time in each engine, cut to whole units."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("engine"), F.col("l_orderkey").alias("trip_id"))
    return rows.agg(F.floor(F.max("l_extendedprice")).cast("long").alias("tt"))


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``engine, link, n``: vehicles on each link."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("engine"), F.col("l_partkey").alias("link"))
    return rows.agg(F.count("*").alias("n"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand: view events, from a user's node to the next one's."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    events = with_next(views, "user_id", ["ts", "event_id"], F.date_trunc("minute", "ts"), "next_user")
    k = F.get_json_object("props", "$.k").cast("long")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return events.select(
        F.concat(F.lit("t"), "event_id").alias("trip_id"),
        F.concat(F.lit("n"), "user_id").alias("origin"),
        F.concat(F.lit("n"), "next_user").alias("destination"),
        seconds.cast("long").alias("departure_time_s"),
        pick(MODES, k % 4).alias("mode"),
        pick(PURPOSES, k % 6).alias("purpose"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network: purchases in order, from a user's node to the next purchaser's."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    rows = with_next(bought, "user_id", ["ts", "event_id"], F.date_trunc("minute", "ts"), "next_user").select(
        F.concat(F.lit("l"), "event_id").alias("link_id"),
        F.col("event_id").alias("link_pos"),
        F.concat(F.lit("n"), "user_id").alias("from_node"),
        F.concat(F.lit("n"), "next_user").alias("to_node"),
        F.col("value").cast("double").alias("length"),
    )
    return rows.where("to_node IS NOT NULL AND from_node <> to_node")


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that enter and leave links."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    return rows.select(
        F.col("user_id").alias("veh"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("link"),
        F.when(F.col("event_type") == "click", "entered").otherwise("left").alias("type"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("event_id").alias("pos"),
    )


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o, d``: nations of customer and supplier of each order's first line."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("o"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("d"))
    joined = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("o").cast("long"), F.col("d").cast("long"))


#: The same tables for DuckDB.
SQL = {
    "runs": """runs AS (SELECT l_returnflag AS scenario, l_linestatus AS engine, CASE WHEN l_linenumber % 2 = 0 THEN 'meso' ELSE 'micro' END AS mode,
      CAST(l_linenumber AS BIGINT) AS seed, CASE WHEN l_tax > 0.07::DOUBLE THEN 'failed' ELSE 'success' END AS status, CAST(l_quantity AS DOUBLE) AS runtime_s,
      CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END AS tt_mean, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END * 1.2::DOUBLE AS tt_p95,
      CAST(l_partkey AS BIGINT) AS trip_count FROM lineitem)""",
    "trip_times": """trip_times AS (SELECT l_linestatus AS engine, l_orderkey AS trip_id, CAST(floor(max(l_extendedprice)) AS BIGINT) AS tt FROM lineitem GROUP BY ALL)""",
    "link_counts": """link_counts AS (SELECT l_linestatus AS engine, l_partkey AS link, count(*) AS n FROM lineitem GROUP BY ALL)""",
    "trips": """trips AS (SELECT 't' || event_id AS trip_id, 'n' || user_id AS origin, 'n' || lead(user_id) OVER (ORDER BY ts, event_id) AS destination,
      CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS departure_time_s,
      ['car', 'transit', 'bike', 'walk'][1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4] AS mode,
      ['HBW_AM', 'HBW_PM', 'HBSchool_AM', 'HBSchool_PM', 'HBW_AM_chained', 'HBW_PM_chained'][1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 6] AS purpose
      FROM events WHERE event_type = 'view')""",
    "links": """links AS (SELECT * FROM (SELECT 'l' || event_id AS link_id, event_id AS link_pos, 'n' || user_id AS from_node,
      'n' || lead(user_id) OVER (ORDER BY ts, event_id) AS to_node, CAST(value AS DOUBLE) AS length
      FROM events WHERE event_type = 'purchase') WHERE to_node IS NOT NULL AND from_node <> to_node)""",
    "link_events": """link_events AS (SELECT user_id AS veh, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS link,
      CASE WHEN event_type = 'click' THEN 'entered' ELSE 'left' END AS type, epoch_us(ts) AS t, event_id AS pos FROM events WHERE event_type IN ('click', 'view'))""",
    "od": """od AS (SELECT CAST(c_nationkey AS BIGINT) AS o, CAST(s_nationkey AS BIGINT) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1)""",
}


def with_views(names: str, select: str) -> str:
    """DuckDB SQL over the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + select
