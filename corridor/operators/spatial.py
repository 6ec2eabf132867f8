"""Spatial joins by grid cells: nearest sites, points in polygons, boxes, polylines."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.functions.geo import cell, haversine_km
from corridor.session import materialise

#: Kilometres of a degree of latitude, from below: cells by it are never too small.
DEGREE_KM = 110.0


#: Sites of a cell beyond which nearer ones are looked for first.
CROWD = 32


def nearest_in_grid(points: DataFrame, sites: DataFrame, size: float, max_km: float) -> DataFrame:
    """``id, site, km``: the nearest site in a point's cell and the eight around, within ``max_km``; the first by ``pos`` of equal ones."""
    near = (F.abs(cell(F.col("lat"), size) - cell(F.col("slat"), size)) <= 1) & (F.abs(cell(F.col("lon"), size) - cell(F.col("slon"), size)) <= 1)

    def last(points: DataFrame, sites: DataFrame) -> DataFrame:
        at = sites.select(F.col("id").alias("site"), "pos", F.col("lat").alias("slat"), F.col("lon").alias("slon"), cell(F.col("lat"), size).alias("cy"), cell(F.col("lon"), size).alias("cx"))
        around = lambda c: F.explode(F.array(c - 1, c, c + 1))
        spread = points.select("id", "lat", "lon", around(cell(F.col("lat"), size)).alias("cy"), cell(F.col("lon"), size).alias("x")).select("id", "lat", "lon", "cy", around(F.col("x")).alias("cx"))
        return _nearest(spread.join(at, ["cy", "cx"]), max_km)

    return _near_first(points, sites, max_km, near, last)


def nearest_within(points: DataFrame, sites: DataFrame, max_km: float) -> DataFrame:
    """``id, site, km``: the nearest of all sites within ``max_km``; the first by ``pos`` of equal ones."""
    return _near_first(points, sites, max_km, F.lit(True), lambda points, sites: _within(points, sites, max_km))


def _near_first(points: DataFrame, sites: DataFrame, max_km: float, counts: Column, last: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The nearest sites by ``last``, after those within a few smaller and growing distances.

    A point's nearest site of all, if it ``counts``, is the one that ``last`` would find, so the point need not
    meet the many sites of a crowded cell. The smallest distance follows the fullest cell.
    """
    band = lambda c: F.floor(F.col(c) * DEGREE_KM / max_km)
    fullest = sites.groupBy(band("lat").alias("y"), band("lon").alias("x")).count().agg(F.max("count")).first()[0] or 0  # one number
    steps = math.ceil(math.log(fullest / CROWD, 16)) if fullest > CROWD else 0
    if not steps:
        return last(points, sites)
    left, sites, done = materialise(points.select("id", "lat", "lon"), "points"), materialise(sites.select("id", "pos", "lat", "lon"), "sites"), []
    for k in range(steps, 0, -1):
        done.append(materialise(_within(left, sites, max_km / 4**k, counts), "nearest"))
        left = materialise(left.join(done[-1].select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_anti"), "points")
    return reduce(DataFrame.union, [*done, last(left, sites)])


def _within(points: DataFrame, sites: DataFrame, max_km: float, counts: Column | None = None) -> DataFrame:
    """Cells are bands of the distance's height; a band's sites are met in as many columns as its latitude asks."""
    size = max_km / DEGREE_KM
    band = lambda c: F.floor(c / size).cast("long")
    at = sites.select(F.col("id").alias("site"), "pos", F.col("lat").alias("slat"), F.col("lon").alias("slon"), band(F.col("lat")).alias("cy"), band(F.col("lon")).alias("cx"))
    reach = F.ceil(1 / F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(89.0))))).cast("long")
    spread = points.select("id", "lat", "lon", F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("cy"), band(F.col("lon")).alias("x"), reach.alias("k"))
    spread = spread.select("id", "lat", "lon", "cy", F.explode(F.sequence(F.col("x") - F.col("k"), F.col("x") + F.col("k"))).alias("cx"))
    return _nearest(spread.join(at, ["cy", "cx"]), max_km, counts)


def _nearest(pairs: DataFrame, max_km: float, counts: Column | None = None) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    near = pairs.withColumn("km", km).withColumn("counts", F.lit(True) if counts is None else counts).where(F.col("km") <= max_km)
    return near.groupBy("id").agg(F.min(F.struct("km", "pos", "site", "counts")).alias("b")).where("b.counts").select("id", "b.site", "b.km")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies within a ring of (``x, y``) corners: an odd number of edges to its right."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        over = (a["y"] > y) != (b["y"] > y)
        return over & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), crosses)) % 2 == 1


def first_polygon(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``id, polygon``: the first polygon (by ``pos``) that holds each point (``id, x, y``); they meet in cells of their boxes."""
    band = lambda c: F.floor(c / size).cast("long")
    ends = lambda axis, f: f(F.transform("ring", lambda p: p[axis]))
    boxed = polygons.select(F.col("id").alias("polygon"), "pos", "ring", *(F.sequence(band(ends(a, F.array_min)), band(ends(a, F.array_max))).alias(f"c{a}") for a in ("x", "y")))
    cells = boxed.select("polygon", "pos", "ring", F.explode("cx").alias("cx"), "cy").withColumn("cy", F.explode("cy"))
    met = points.select("id", "x", "y", band(F.col("x")).alias("cx"), band(F.col("y")).alias("cy")).join(cells, ["cx", "cy"])
    return met.where(inside(F.col("x"), F.col("y"), F.col("ring"))).groupBy("id").agg(F.min_by("polygon", "pos").alias("polygon"))


def box_of(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def arc_lengths(points: DataFrame) -> DataFrame:
    """Points (``line, pos, x, y``) with the length of their line up to them."""
    order = W.partitionBy("line").orderBy("pos")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("upto", F.sum("_step").over(order)).drop("_step")


def along(points: DataFrame, progress: Column) -> DataFrame:
    """``line, x, y`` at a share of each line's length; its only point where the length is 0."""
    order, whole = W.partitionBy("line").orderBy("pos"), W.partitionBy("line")
    cut = arc_lengths(points).withColumns({"total": F.max("upto").over(whole), "nx": F.lead("x").over(order), "ny": F.lead("y").over(order), "next": F.lead("upto").over(order)})
    goal = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0)) * F.col("total")
    last = F.col("next").isNull()
    held = cut.where((F.col("upto") <= goal) & (last | (F.col("next") > goal)))
    share = F.coalesce(F.try_divide(goal - F.col("upto"), F.col("next") - F.col("upto")), F.lit(0.0))
    mid = lambda a, b: F.when(last, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    return held.groupBy("line").agg(F.max_by(mid("x", "nx"), "pos").alias("x"), F.max_by(mid("y", "ny"), "pos").alias("y"))
