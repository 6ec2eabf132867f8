"""Exact weighted draws of a place by its mass and its distance, without weighing all places for each draw.

A weight is a sum of components, each the mass of a place times a function of its distance.
Places lie in a tree of grid cells with sums of their masses. For a draw, a cell's weight is
bounded by its masses times the greatest that the functions reach between the cell's nearest
and farthest point. A draw walks down by these bounds (one random number, less what lies
before the chosen cell), takes a place of the leaf by its mass and keeps it by the true weight
over the bound; where the bounds leave slack it is rejected. A kept place has exactly the
probability of its weight. Cells are weighed in numpy, a batch of draws at a time: those of the
first ``TOP_LEVELS`` levels, whose number is bounded, are at hand in each task, deeper ones are joined. Rejected draws are tried again, in rounds of more and more tries,
until none is left; the few that ``PATIENCE`` tries leave open are drawn by weighing every
place whose cell may count, as are draws for which no place counts: those alone get none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions.geo import EARTH_KM, haversine_km
from corridor.operators.ranges import running_sums
from corridor.session import materialise

#: Places of a leaf, on average; cells of a level are cut into 4 by 4.
LEAF = 32
#: Tries after which the rest is weighed place by place.
PATIENCE = 1364
#: Levels whose cells are sure to be few: 256 at most.
FEW_LEVELS = 2
#: Levels walked without a join: 4,368 cells at most.
TOP_LEVELS = 3

#: The same formulas for columns and for arrays.
COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, asin=F.asin, sqrt=F.sqrt, abs=F.abs, exp=F.exp, radians=F.radians, pow=lambda a, b: F.pow(a, F.lit(b)), least=lambda a, b: F.least(_lit(a), _lit(b)), greatest=lambda a, b: F.greatest(_lit(a), _lit(b)), where=lambda c, a, b: F.when(c, a).otherwise(b))
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, asin=np.arcsin, sqrt=np.sqrt, abs=np.abs, exp=np.exp, radians=np.radians, pow=np.power, least=np.minimum, greatest=np.maximum, where=np.where)


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform(seed: int, key: Column, draw: str) -> Column:
    """A number in [0, 1) for a row's key and a named draw: 52 bits of a hash."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), key.cast("string"), F.lit(draw))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


class Component(NamedTuple):
    """A part of the weight: ``scale`` times the places' whole-number ``mass`` times ``exact`` of the distance, which ``upper`` bounds between two distances.

    ``upper`` takes the functions to use (``COLUMNS`` or ``ARRAYS``), the two distances, and what gives a draw's column by name.
    """

    mass: str
    scale: Column
    upper: Callable[[SimpleNamespace, Any, Any, Callable[[str], Any]], Any]
    exact: Callable[[Column], Column]


class Tree(NamedTuple):
    """``kids`` by level (``cell`` with its cells), and the ``items`` of leaves: a component's interval of each place, in buckets."""

    levels: int
    kids: list[DataFrame]
    items: DataFrame
    places: DataFrame
    widths: list[int]


def _id(level: int, x: Column, y: Column) -> Column:
    return F.concat_ws("/", F.lit(level), x, y)


def tree(places: DataFrame, masses: list[str], leaf: int = LEAF) -> Tree:
    """The tree of ``places`` (``node, idx, lat, lon`` and masses; ``idx`` is unique)."""
    n = places.count()
    levels = max(1, math.ceil(math.log(max(1, n) / leaf, 16)))
    side = 4**levels
    ends = places.agg(F.min("lat").alias("_y0"), F.max("lat").alias("_y1"), F.min("lon").alias("_x0"), F.max("lon").alias("_x1"))  # one row
    step = lambda v, a, b: F.coalesce(F.least(F.floor(F.try_divide(F.col(v) - F.col(a), F.col(b) - F.col(a)) * side), F.lit(side - 1)), F.lit(0)).cast("long")
    placed = places.crossJoin(F.broadcast(ends)).select(*places.columns, step("lon", "_x0", "_x1").alias("x"), step("lat", "_y0", "_y1").alias("y"))
    placed = materialise(placed.withColumn("cell", _id(levels, F.col("x"), F.col("y"))), "places")
    kids = []
    for level in range(levels):
        cut = 4 ** (levels - level - 1)
        own = placed.groupBy(F.floor(F.col("x") / cut).alias("x"), F.floor(F.col("y") / cut).alias("y"))
        cells = own.agg(*(f(c).alias(f"{c}{i}") for c in ("lat", "lon") for i, f in enumerate((F.min, F.max))), *(F.sum(m).cast("long").alias(m) for m in masses))
        body = F.struct(_id(level + 1, F.col("x"), F.col("y")).alias("id"), "lat0", "lat1", "lon0", "lon1", *masses)
        parent = _id(level, F.floor(F.col("x") / 4), F.floor(F.col("y") / 4))
        kids.append(materialise(cells.groupBy(parent.alias("cell")).agg(F.sort_array(F.collect_list(body)).alias("kids")), "cells"))
    items, widths = None, []
    for c, mass in enumerate(masses):
        total = placed.agg(F.sum(mass)).first()[0] or 0  # one number
        widths.append(max(1, -(-total * leaf // max(1, n))))
        sums = running_sums(placed.select("cell", "node", "idx", "lat", "lon", F.col(mass).cast("long").alias("w")), ["cell"], "idx", ["w"]).where("w > 0")
        own = sums.select("cell", F.lit(c).alias("part"), "node", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), (F.col("w_upto") - F.col("w")).alias("lo"), F.col("w_upto").alias("hi"))
        own = own.withColumn("bucket", F.explode(F.expr(f"sequence(lo div {widths[c]}, (hi - 1) div {widths[c]})")))
        items = own if items is None else items.union(own)
    return Tree(levels, kids, materialise(items, "items"), placed, widths)


def _ends(c: Any, m: SimpleNamespace = COLUMNS, col: Callable[[str], Any] = F.col) -> tuple[Any, Any]:
    """Bounds of the distance, in km, from ``lat, lon`` to any point of a cell."""
    half = lambda x: m.pow(m.sin(m.radians(x) / 2), 2.0)
    gap = lambda v, k: m.greatest(m.greatest(0.0, c[f"{k}0"] - v), v - c[f"{k}1"])
    reach = lambda v, k: m.greatest(m.abs(v - c[f"{k}0"]), m.abs(v - c[f"{k}1"]))
    cos0, cos1, own = m.cos(m.radians(c["lat0"])), m.cos(m.radians(c["lat1"])), m.cos(m.radians(col("lat")))
    most = m.where((c["lat0"] <= 0) & (c["lat1"] >= 0), 1.0, m.greatest(cos0, cos1))
    km = lambda a: 2 * EARTH_KM * m.asin(m.sqrt(m.least(a, 1.0)))
    near = km(half(gap(col("lat"), "lat")) + own * m.least(cos0, cos1) * half(gap(col("lon"), "lon")))
    far = km(half(reach(col("lat"), "lat")) + own * most * half(reach(col("lon"), "lon")))
    return near * (1 - 1e-9), far * (1 + 1e-9)


def _weighed(kids: Column, parts: list[Component], names: list[str]) -> Column:
    """A row with the cells: ``near, far``, masses, and the interval ``lo, hi`` of the bounds of their weights. As a generator, so that it is computed once."""
    own = ["id", "near", "far", *names]
    placed = F.transform(kids, lambda c: F.struct(c["id"].alias("id"), *(x.alias(k) for k, x in zip(("near", "far"), _ends(c))), *(c[m].alias(m) for m in names)))
    sizes = lambda c: [p.upper(COLUMNS, c["near"], c["far"], F.col) * p.scale * c[p.mass] for p in parts]
    bound = lambda c: functools.reduce(lambda a, b: a + b, sizes(c))
    none = F.struct(F.lit("").alias("id"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"), *(F.lit(0).cast("long").alias(m) for m in names), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    after = lambda a, c: F.concat(a, F.array(F.struct(*(c[k].alias(k) for k in own), F.element_at(a, -1)["hi"].alias("lo"), (F.element_at(a, -1)["hi"] + bound(c)).alias("hi"))))
    return F.explode(F.array(F.aggregate(placed, F.array(none), after)))


def _joined(rows: DataFrame, own: Tree, level: int) -> DataFrame:
    if level == 0:
        return rows.crossJoin(F.broadcast(own.kids[0].drop("cell")))  # one row
    kids = own.kids[level]
    return rows.join(F.broadcast(kids) if level <= FEW_LEVELS else kids, "cell")


class _Cells(NamedTuple):
    """Cells of several parents in a row, by column, and which of them are a parent's."""

    of: dict[str, np.ndarray]
    ids: pa.Array
    start: np.ndarray
    size: np.ndarray


def _cells(kids: pa.Array, names: list[str]) -> _Cells:
    """Of an array with the cells of each parent."""
    start = np.asarray(kids.offsets.to_numpy())
    every = kids.values
    return _Cells({c: every.field(c).to_numpy(zero_copy_only=False) for c in ("lat0", "lat1", "lon0", "lon1", *names)}, every.field("id"), start[:-1], np.diff(start))


def _step(at: np.ndarray, cells: _Cells, parts: list[tuple[str, Callable]], row: dict[str, np.ndarray], x: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """For draws at the parents ``at``: who chose a cell, that cell, what is left of ``x`` (made of the sum of bounds) in it, and its bounds by part."""
    most = int(cells.size[at].max(initial=1))
    pos = np.minimum(cells.start[at][:, None] + np.arange(most), len(cells.ids) - 1)
    inside = np.arange(most) < cells.size[at][:, None]
    c = {k: v[pos] for k, v in cells.of.items()}
    col = lambda name: row[name][:, None]
    near, far = _ends(c, ARRAYS, col)
    uppers = [np.broadcast_to(upper(ARRAYS, near, far, col), pos.shape) for _, upper in parts]
    bound = functools.reduce(lambda a, b: a + b, (u * col(f"_scale{i}") * c[mass] for i, ((mass, _), u) in enumerate(zip(parts, uppers))))
    hi = np.cumsum(np.where(inside, bound, 0.0), axis=1)
    lo = np.concatenate([np.zeros((len(at), 1)), hi[:, :-1]], axis=1)
    goal = x(hi[:, -1])
    chosen = (lo <= goal[:, None]) & (goal[:, None] < hi)
    who, which = chosen.any(axis=1).nonzero()[0], chosen.argmax(axis=1)
    which = which[who]
    return who, pos[who, which], goal[who] - lo[who, which], np.stack([u[who, which] for u in uppers], axis=1)


def _walked(rows: DataFrame, own: Tree, parts: list[Component]) -> DataFrame:
    """``rows`` (with ``_u``, a number in [0, 1)) walked down to a leaf's ``cell``: the ``part``, its unit ``_t`` of the leaf's mass, and the bound ``_most``."""
    base, names = [c for c in rows.columns if c != "_u"], list(dict.fromkeys(p.mass for p in parts))
    few, top = [(p.mass, p.upper) for p in parts], min(own.levels, TOP_LEVELS)
    held = [own.kids[level].orderBy("cell").toArrow() for level in range(top)]  # bounded by TOP_LEVELS
    typed = "cell string, _rest double, " + ", ".join(f"_upper{i} double, _mass{i} bigint" for i in range(len(parts)))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_u")
    wide = rows.select(*rows.columns, *(p.scale.cast("double").alias(f"_scale{i}") for i, p in enumerate(parts)))
    numeric = [f.name for f in wide.schema if f.dataType.typeName() in ("double", "long", "integer")]

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in numeric if c in batch.schema.names}

    def written(batch: pa.RecordBatch, keep: np.ndarray, cells: _Cells, cell: np.ndarray, rest: np.ndarray, upper: np.ndarray) -> pa.RecordBatch:
        kept = batch.select(base).take(pa.array(keep))
        ends = [cells.ids.take(pa.array(cell)), pa.array(rest)]
        for i, (mass, _) in enumerate(few):
            ends += [pa.array(upper[:, i]), pa.array(cells.of[mass][cell].astype(np.int64))]
        return pa.record_batch([*kept.columns, *ends], names=[*base, *[t.split()[0] for t in typed.split(", ")]])

    def from_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_cells(t.column("kids").combine_chunks(), names) for t in held]
        parent = [{c: i for i, c in enumerate(t.column("cell").to_pylist())} for t in held]
        down = [np.array([parent[i + 1].get(c, 0) for c in levels[i].ids.to_pylist()]) for i in range(top - 1)]
        for batch in batches:
            row = read(batch)
            keep, at, rest = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), row["_u"]
            for level, cells in enumerate(levels):
                x = (lambda total: rest * total) if level == 0 else (lambda total: rest)
                who, cell, rest, upper = _step(at, cells, few, {c: v[keep] for c, v in row.items()}, x)
                keep, at = keep[who], down[level][cell] if level < top - 1 else cell
            yield written(batch, keep, levels[-1], cell, rest, upper)

    def one_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cells = read(batch), _cells(batch.column("kids"), names)
            who, cell, rest, upper = _step(np.arange(batch.num_rows), cells, few, row, lambda total: row["_rest"])
            yield written(batch, who, cells, cell, rest, upper)

    out = wide.mapInArrow(from_top, f"{plain}, {typed}")
    for level in range(top, own.levels):
        deeper = out.select(*base, "cell", "_rest", *(p.scale.cast("double").alias(f"_scale{i}") for i, p in enumerate(parts))).join(own.kids[level], "cell")
        numeric.append("_rest")
        out = deeper.mapInArrow(one_down, f"{plain}, {typed}")
    before, part, share, most = F.lit(0.0), F, F, F
    for c, p in enumerate(parts):
        size = F.col(f"_upper{c}") * p.scale * F.col(f"_mass{c}")
        here = F.col("_rest") < before + size
        part, share = part.when(here, c), share.when(here, F.greatest(F.lit(0.0), F.least((F.col("_rest") - before) / size, F.lit(1 - 2.0**-52))) * F.col(f"_mass{c}"))
        most = most.when(here, F.col(f"_upper{c}"))
        before = before + size
    return out.select(*base, "cell", part.alias("part"), F.floor(share).alias("_t"), most.alias("_most")).where("part IS NOT NULL")


def _tried(rows: DataFrame, own: Tree, parts: list[Component], seed: int) -> DataFrame:
    """Of ``rows`` (a draw's columns and its try ``j``) those that keep a place, with it as ``node``."""
    base = rows.columns
    rows = rows.withColumn("_key", F.concat_ws(".", "k", "j"))
    rows = _walked(rows.withColumn("_u", uniform(seed, F.col("_key"), "cell")), own, parts)
    width = F.element_at(F.array(*map(F.lit, own.widths)), F.col("part") + 1)
    met = rows.withColumn("bucket", F.floor(F.col("_t") / width)).join(own.items, ["cell", "part", "bucket"]).where("_t >= lo AND _t < hi AND node <> origin")
    km, exact = haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")), F
    for c, p in enumerate(parts):
        exact = exact.when(F.col("part") == c, p.exact(F.col("_km")))
    return met.withColumn("_km", km).where(uniform(seed, F.col("_key"), "keep") * F.col("_most") < exact).select(*base, "node")


def _all_weighed(rows: DataFrame, own: Tree, parts: list[Component], seed: int) -> DataFrame:
    """A place for each row by the weights of all places whose cells may count: the least of ``-ln(u) / weight``. Rows without such a place go."""
    base, names = rows.columns, list(dict.fromkeys(p.mass for p in parts))
    for level in range(own.levels):
        at = _joined(rows, own, level).select(*base, _weighed(F.col("kids"), parts, names).alias("_cells")).select(*base, F.explode("_cells").alias("_c"))
        rows = at.where("_c.hi > _c.lo").select(*base, F.col("_c.id").alias("cell"))
    met = rows.join(own.places.select("cell", "node", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), *names), "cell").where("node <> origin")
    met = met.withColumn("_km", haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    weight = sum((p.exact(F.col("_km")) * p.scale * F.col(p.mass) for p in parts[1:]), parts[0].exact(F.col("_km")) * parts[0].scale * F.col(parts[0].mass))
    late = F.try_divide(-F.log(1 - uniform(seed, F.concat_ws(".", "k", "node"), "all")), F.col("_w"))
    return met.withColumn("_w", weight).where("_w > 0").groupBy(*base).agg(F.min_by("node", late).alias("node"))


def draw(rows: DataFrame, places: DataFrame, parts: list[Component], seed: int, leaf: int = LEAF, patience: int = PATIENCE) -> DataFrame:
    """``rows`` (``k`` unique, ``origin, lat, lon`` and what the parts ask for) with a ``destination`` other than the origin.

    Only rows for which no place has a weight above 0 are left out.
    """
    own = tree(places, list(dict.fromkeys(p.mass for p in parts)), leaf)
    left, done, j, tries = materialise(rows, "draws"), None, 0, 4
    n, cores = left.count(), rows.sparkSession.sparkContext.defaultParallelism
    while n:
        if j >= patience:
            found = _all_weighed(left, own, parts, seed)
        else:
            # few rows, much work for each: as many tasks as there are cores
            dealt = left.repartition(max(cores, left.rdd.getNumPartitions()), "k")
            spread = dealt.withColumn("j", F.explode(F.sequence(F.lit(j), F.lit(j + tries - 1))))
            found = _tried(spread, own, parts, seed).groupBy(*rows.columns).agg(F.min_by("node", "j").alias("node"))
        found = materialise(found, "drawn")
        done = found if done is None else done.union(found)
        if j >= patience:
            break
        left = materialise(left.join(found.select("k"), "k", "left_anti"), "draws")
        n, j, tries = left.count(), j + tries, tries * 4
    done = rows.withColumn("node", F.lit(None).cast("string")).limit(0) if done is None else done
    return done.withColumnRenamed("node", "destination")


#: The walk in DuckDB over ``places`` (node, idx, lat, lon, m0, m1) and ``draws`` (k, origin, lat, lon and more); ``{{...}}`` are the parts.
SQL = """
ends AS (SELECT min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1, greatest(1, CAST(ceil(ln(count(*) / 32.0::DOUBLE) / ln(16.0::DOUBLE)) AS BIGINT)) AS depth FROM places),
placed AS (SELECT p.*, depth, CAST(coalesce(least(floor((lon - x0) / nullif(x1 - x0, 0) * pow(4, depth)), pow(4, depth) - 1), 0) AS BIGINT) AS x, CAST(coalesce(least(floor((lat - y0) / nullif(y1 - y0, 0) * pow(4, depth)), pow(4, depth) - 1), 0) AS BIGINT) AS y FROM places p, ends),
cells AS (SELECT l AS level, x // CAST(pow(4, depth - l) AS BIGINT) AS cx, y // CAST(pow(4, depth - l) AS BIGINT) AS cy, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1, CAST(sum(m0) AS BIGINT) AS m0, CAST(sum(m1) AS BIGINT) AS m1 FROM placed, (SELECT unnest(range(1, depth + 1)) AS l FROM ends) GROUP BY ALL),
kids AS (SELECT (level - 1) || '/' || (cx // 4) || '/' || (cy // 4) AS cell, list(struct_pack(id := level || '/' || cx || '/' || cy, lat0 := lat0, lat1 := lat1, lon0 := lon0, lon1 := lon1, m0 := m0, m1 := m1) ORDER BY level || '/' || cx || '/' || cy) AS kids FROM cells GROUP BY 1),
leafed AS (SELECT *, depth || '/' || x || '/' || y AS cell FROM placed),
items AS (SELECT cell, 0 AS part, node AS to_node, lat AS to_lat, lon AS to_lon, sum(m0) OVER (PARTITION BY cell ORDER BY idx) - m0 AS lo, sum(m0) OVER (PARTITION BY cell ORDER BY idx) AS hi FROM leafed
  UNION ALL SELECT cell, 1, node, lat, lon, sum(m1) OVER (PARTITION BY cell ORDER BY idx) - m1, sum(m1) OVER (PARTITION BY cell ORDER BY idx) FROM leafed),
walk AS (
  SELECT draws.*, 0 AS j, 0 AS level, '0/0/0' AS cell, 0.0::DOUBLE AS rest, CAST(NULL AS STRUCT(id VARCHAR, near DOUBLE, far DOUBLE, m0 BIGINT, m1 BIGINT, bound DOUBLE)) AS leaf, CAST(NULL AS VARCHAR) AS destination FROM draws
  UNION ALL
  SELECT {own}, CASE WHEN i < len(cs) OR kept THEN j ELSE j + 1 END, CASE WHEN i < len(cs) THEN level + 1 ELSE 0 END, CASE WHEN i < len(cs) THEN cs[i + 1].id ELSE '0/0/0' END, CASE WHEN i < len(cs) THEN x - sums[i + 1] ELSE 0 END,
    CASE WHEN i < len(cs) THEN cs[i + 1] END, CASE WHEN kept THEN to_node END
  FROM (SELECT *, coalesce(to_node <> origin AND {keep} * CASE part WHEN 0 THEN up0 ELSE up1 END < CASE part WHEN 0 THEN {exact0} ELSE {exact1} END, false) AS kept
    FROM (SELECT c.*, to_node, 12742.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(to_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(to_lat)) * pow(sin(radians(to_lon - lon) / 2), 2)))) AS km
      FROM (SELECT *, coalesce(len(list_filter(sums[2:], lambda s: s <= x)), 99) AS i, CASE WHEN rest < b0 THEN 0 WHEN rest < b0 + b1 THEN 1 END AS part,
          CAST(floor(CASE WHEN rest < b0 THEN greatest(0, least(rest / b0, 1 - pow(2.0::DOUBLE, -52))) * leaf.m0 ELSE greatest(0, least((rest - b0) / b1, 1 - pow(2.0::DOUBLE, -52))) * leaf.m1 END) AS BIGINT) AS t
        FROM (SELECT *, CASE WHEN level = 0 THEN {pick} * sums[-1] ELSE rest END AS x, up0 * {scale0} * leaf.m0 AS b0, up1 * {scale1} * leaf.m1 AS b1
          FROM (SELECT *, list_transform(range(0, len(cs) + 1), lambda n: list_reduce(list_prepend(0.0::DOUBLE, list_transform(cs[:n], lambda c: c.bound)), lambda a, b: a + b)) AS sums, {leaf_upper0} AS up0, {leaf_upper1} AS up1
            FROM (SELECT {own}, j, level, walk.cell, rest, leaf, list_transform(list_transform(kids, lambda c: struct_pack(id := c.id, near := {near} * (1 - 1e-9::DOUBLE), far := {far} * (1 + 1e-9::DOUBLE), m0 := c.m0, m1 := c.m1)), lambda c: struct_pack(id := c.id, near := c.near, far := c.far, m0 := c.m0, m1 := c.m1, bound := {cell_upper0} * {scale0} * c.m0 + {cell_upper1} * {scale1} * c.m1)) AS cs
              FROM walk CROSS JOIN ends LEFT JOIN kids ON kids.cell = walk.cell AND level < depth WHERE destination IS NULL)))) c
      LEFT JOIN items ON c.leaf IS NOT NULL AND items.cell = c.cell AND items.part = c.part AND c.cs IS NULL AND c.t >= lo AND c.t < hi)))
"""


def sql(own: list[str], uppers: list[str], exacts: list[str], scales: list[str], u: Callable[[str, str], str]) -> str:
    """The common table expressions of the walk: ``uppers`` in ``{near}`` and ``{far}``, ``exacts`` in ``km``; ``own`` are the draws' columns, ``u`` a draw's uniform number."""
    half = "pow(sin(radians({}) / 2), 2)"
    gap = lambda v: half.format(f"greatest(0.0::DOUBLE, c.{v}0 - {v}, {v} - c.{v}1)")
    reach = lambda v: half.format(f"greatest(abs({v} - c.{v}0), abs({v} - c.{v}1))")
    cos = "cos(radians(c.lat{}))".format
    least, most = f"least({cos(0)}, {cos(1)})", f"CASE WHEN c.lat0 <= 0 AND c.lat1 >= 0 THEN 1.0::DOUBLE ELSE greatest({cos(0)}, {cos(1)}) END"
    km = lambda a, b, c: f"12742.0::DOUBLE * asin(sqrt(least(1, {a} + cos(radians(lat)) * {b} * {c})))"
    at = lambda where: {f"{where}_upper{i}": f"({x.format(near=f'{'c' if where == 'cell' else 'leaf'}.near', far=f'{'c' if where == 'cell' else 'leaf'}.far')})" for i, x in enumerate(uppers)}
    return SQL.format(
        own=", ".join(own), pick=u("k || '.' || j", "cell"), keep=u("k || '.' || j", "keep"), near=km(gap("lat"), least, gap("lon")), far=km(reach("lat"), f"({most})", reach("lon")),
        exact0=exacts[0], exact1=exacts[1], scale0=scales[0], scale1=scales[1], **at("cell"), **at("leaf"),
    )
