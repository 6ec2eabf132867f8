"""Event streams of vehicles on links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def throughput(events: DataFrame, bin_us: int) -> DataFrame:
    """Vehicles that enter each link by time bin."""
    start = F.floor(F.col("t") / bin_us).cast("long") * bin_us
    return events.where("type = 'entered'").groupBy(start.alias("bin"), "link").agg(F.count("*").alias("n"))


def visits(events: DataFrame) -> DataFrame:
    """``veh, link, t_in, t_out``: a leave matches where the key's event just before is an enter, later than it."""
    order = W.partitionBy("veh", "link").orderBy("t", "pos")
    rows = events.withColumns({"type_before": F.lag("type").over(order), "t_in": F.lag("t").over(order)})
    paired = rows.where("type = 'left' AND type_before = 'entered' AND t > t_in")
    return paired.select("veh", "link", "t_in", F.col("t").alias("t_out"))


def active_at(stays: DataFrame, frames: DataFrame, bin_us: int) -> DataFrame:
    """Vehicles on a link at each frame time (``t``): stays are cut into time bins, which frames join by equality."""
    cut = stays.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t_in") / bin_us), F.floor(F.col("t_out") / bin_us))))
    at = frames.withColumn("bin", F.floor(F.col("t") / bin_us))
    return cut.join(at, "bin").where("t BETWEEN t_in AND t_out").groupBy("t").agg(F.count("*").alias("active"))


def positions_at(stays: DataFrame, frames: DataFrame, bin_us: int) -> DataFrame:
    """Vehicles on a link at each frame time with the share of their stay that has passed."""
    cut = stays.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t_in") / bin_us), F.floor(F.col("t_out") / bin_us))))
    at = frames.withColumn("bin", F.floor(F.col("t") / bin_us))
    return cut.join(at, "bin").where("t BETWEEN t_in AND t_out").select("t", "veh", "link", ((F.col("t") - F.col("t_in")) / (F.col("t_out") - F.col("t_in"))).alias("progress"))
