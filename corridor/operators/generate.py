"""Demand by hashed randomness: a draw depends on the seed, its row's key and its number alone, never on partitions.

Weighted draws invert running sums of whole weights; where distance counts, ``draws.draw``
walks down a tree of cells. Every trip asked for is made, where the nodes allow any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions import clock
from corridor.operators.draws import COLUMNS, Component, draw, uniform
from corridor.operators.ranges import numbered, running_sums
from corridor.session import materialise

#: Morning and evening peaks, and the share of trips in them.
PEAKS = ((25_200, 32_400), (61_200, 68_400))
PEAK_SHARE = 0.7
#: Arrivals at work and at home.
ARRIVE_WORK, ARRIVE_HOME = 28_800, 61_200
BUCKETS = 1024


def pick(draws: DataFrame, u: str, items: DataFrame, name: str) -> DataFrame:
    """``draws`` with an item's ``node`` as ``name``, by whole weights ``w`` in the order of ``idx``: the first whose running sum is above ``u`` times all.

    Intervals and draws meet in buckets of equal weight.
    """
    total = items.agg(F.sum("w").alias("_total"))  # one row
    width = F.greatest(F.lit(1), F.ceil(F.col("_total") / BUCKETS))
    sums = running_sums(items.select("node", "idx", "w"), [], "idx", ["w"]).where("w > 0").crossJoin(F.broadcast(total))
    sums = sums.select(F.col("node").alias(name), (F.col("w_upto") - F.col("w")).alias("_lo"), F.col("w_upto").alias("_hi"), width.alias("_width"))
    sums = sums.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_width")), F.floor((F.col("_hi") - 1) / F.col("_width"))))).drop("_width")
    placed = draws.crossJoin(F.broadcast(total)).withColumn("_t", F.floor(F.col(u) * F.col("_total"))).withColumn("_b", F.floor(F.col("_t") / width))
    return placed.join(sums, "_b").where("_t >= _lo AND _t < _hi").select(*draws.columns, name)


def uniform_pairs(trips: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """``trips`` (``k`` and more) with ``origin, destination``: any two different nodes (``node, idx``), for every trip where there are two.

    The destination is one of the others by its place among them, so none is drawn again. Places are numbered and written once.
    """
    placed = materialise(numbered(nodes.select("node", "idx"), ["idx"], F.floor(F.col("idx") / 1000), "place").select("node", "place"), "places")
    n = placed.agg(F.count("*").alias("_n"))  # one row
    rows = trips.crossJoin(F.broadcast(n)).where("_n > 1")
    rows = rows.select(*trips.columns, *(F.floor(uniform(seed, F.col("k"), d) * (F.col("_n") - less)).alias(f"_{d}") for d, less in (("origin", 0), ("destination", 1))))
    rows = rows.withColumn("_destination", F.col("_destination") + F.when(F.col("_destination") >= F.col("_origin"), 1).otherwise(0))
    for end in ("origin", "destination"):
        rows = rows.join(placed.select(F.col("place").alias(f"_{end}"), F.col("node").alias(end)), f"_{end}")
    return rows.select(*trips.columns, "origin", "destination")


def gravity_pairs(trips: DataFrame, nodes: DataFrame, seed: int, decay: float = 1.0, near: float = 0.5, far: float = 10.0) -> DataFrame:
    """``k, origin, destination`` of nodes (``node, idx, degree, lat, lon``): origins by degree + 1, destinations by weight.

    Within the bounds of distance the weight of a destination is its share of degrees times
    ``1 / (d^decay + 0.1)``, beyond them 0.01. Every trip is placed where there are two nodes.
    """
    nodes = materialise(nodes.select("node", "idx", "degree", "lat", "lon"), "nodes")
    items = nodes.select("node", "idx", "lat", "lon", "degree", (F.col("degree") + 1).cast("bigint").alias("w"))
    rows = pick(trips.select("k").withColumn("_o", uniform(seed, F.col("k"), "origin")), "_o", items, "origin")
    rows = rows.join(nodes.select(F.col("node").alias("origin"), "lat", "lon"), "origin")
    rows = rows.crossJoin(F.broadcast(nodes.agg((1.0 / F.greatest(F.sum("degree"), F.lit(1))).alias("per_degree"))))  # one row
    pull = lambda d, m=COLUMNS: 1 / (m.pow(d, decay) + 0.1)
    within = lambda d: (d >= near) & (d <= far)
    parts = [
        Component("w", F.col("per_degree"), lambda m, a, b, _: m.where((b < near) | (a > far), 0.0, pull(m.greatest(a, near), m)), lambda d: F.when(within(d), pull(d)).otherwise(0.0)),
        Component("one", F.lit(1.0), lambda m, a, b, _: m.where((a >= near) & (b <= far), 0.0, 0.01), lambda d: F.when(within(d), 0.0).otherwise(0.01)),
    ]
    found = draw(rows.select("k", "origin", "lat", "lon", "per_degree"), items.withColumn("one", F.lit(1).cast("bigint")), parts, seed)
    return found.select("k", "origin", "destination")


def peak_departure(seed: int, key: Column, start: int, end: int) -> Column:
    """Seconds of departure: mostly within a peak that the horizon holds, else anywhere in it."""
    u = lambda draw: uniform(seed, key, draw)
    anywhere = F.lit(start) + u("time") * (end - start)
    in_peak = F
    for half, (a, b) in zip((u("peak") < 0.5, u("peak") >= 0.5), PEAKS):
        lo, hi = max(a, start), min(b, end)
        if lo < hi:
            in_peak = in_peak.when((u("share") < PEAK_SHARE) & half, F.lit(lo) + u("time") * (hi - lo))
    return F.floor(anywhere if in_peak is F else in_peak.otherwise(anywhere)).cast("int")


def peak_split(n: Column, start: Column, end: Column) -> dict[str, Column]:
    """Trips of the morning and of the afternoon: half each where the horizon holds both arrivals."""
    am, pm = (F.lit(x).between(start, end) for x in (ARRIVE_WORK, ARRIVE_HOME))
    morning = F.when(am & pm, F.floor(n / 2)).when(pm, 0).otherwise(n)
    return {"am": morning, "pm": n - morning}


def within_budget(rows: DataFrame, order: str, cost: str, budget: int) -> DataFrame:
    """``rows`` in ``order`` until the budget is used, with ``granted``: the cost, or 1 where it no longer fits."""
    run = running_sums(rows, [], order, [cost])
    prior = F.col(f"{cost}_upto") - F.col(cost)
    granted = F.when(prior + F.col(cost) <= budget, F.col(cost)).otherwise(1)
    return run.where(prior < budget).select(*rows.columns, granted.alias("granted"))


def schedule_trips(people: DataFrame, budget: int, morning: bool, start: int, end: int) -> DataFrame:
    """Trips of scheduled people (``id, home, work, school, commute_min, mode, place``) in the order of ``place``.

    With a school (neither home nor work) it is two trips by it where the budget holds both, else one between home and work.
    """
    rows = within_budget(people.withColumn("cost", F.when(F.expr("school <> home AND school <> work"), 2).otherwise(1)), "place", "cost", budget)
    arrival = ARRIVE_WORK if morning else ARRIVE_HOME
    leave = clock.departure(F.col("commute_min"), start, end, arrival)
    a, b = ("home", "work") if morning else ("work", "home")
    plain, first, second = ("HBW_AM", "HBSchool_AM", "HBW_AM_chained") if morning else ("HBW_PM", "HBW_PM_chained", "HBSchool_PM")
    leg = lambda o, d, p: F.struct(F.col(o).alias("origin"), F.col(d).alias("destination"), F.lit(p).alias("purpose"))
    legs = F.when(F.col("granted") == 2, F.array(leg(a, "school", first), leg("school", b, second))).otherwise(F.array(leg(a, b, plain)))
    return rows.select("id", F.posexplode(legs).alias("leg", "x"), leave.alias("departure_time_s"), "mode").select("id", "leg", "x.*", "departure_time_s", "mode", F.lit("schedule").alias("dest_source"))


def gaussian_pairs(people: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """``k, origin, destination``: where people (``k, home, commute_min``) go for whom no schedule says it.

    The weight of a node (``node, idx, degree, lat, lon``) is (degree + 1) times a bell around half
    the commute in km (0.5 to 15), 0 within 0.1 km. Only who has no such node goes nowhere.
    """
    goal = F.greatest(F.lit(0.5), F.least(F.lit(15.0), F.col("commute_min") * 0.5))
    rows = people.select("k", F.col("home").alias("origin"), goal.alias("goal")).join(nodes.select(F.col("node").alias("origin"), "lat", "lon"), "origin")
    bell = lambda d, m=COLUMNS, col=F.col: m.exp(m.pow((d - col("goal")) / (col("goal") * 0.7 + 0.5), 2.0) * -0.5)
    best = lambda m, a, b, col: bell(m.least(m.greatest(m.greatest(col("goal"), a), 0.1), m.greatest(b, 0.1)), m, col)
    part = Component("w", F.lit(1.0), lambda m, a, b, col: m.where(b < 0.1, 0.0, best(m, a, b, col)), lambda d: F.when(d >= 0.1, bell(d)).otherwise(0.0))
    items = nodes.select("node", "idx", "lat", "lon", (F.col("degree") + 1).cast("bigint").alias("w"))
    return draw(rows.select("k", "origin", "lat", "lon", "goal"), items, [part], seed).select("k", "origin", "destination")


def fallback_trips(people: DataFrame, nodes: DataFrame, n_am: int, n_pm: int, seed: int, start: int, end: int) -> DataFrame:
    """``n_am + n_pm`` trips of people (``id, home, commute_min, mode, place``, homes among the nodes) drawn anew for each, so homes count by who lives there; the afternoon's go back."""
    return _drawn_trips(*_kept(people, nodes), n_am, n_pm, seed, start, end)


def _kept(people: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both written once, as they are read in many places."""
    return materialise(people, "people"), materialise(nodes.select("node", "idx", "degree", "lat", "lon"), "nodes")


def _drawn_trips(people: DataFrame, nodes: DataFrame, n_am: int, n_pm: int, seed: int, start: int, end: int) -> DataFrame:
    spark = people.sparkSession
    trips = spark.range(n_am + n_pm).select(F.col("id").alias("k"), (F.col("id") < n_am).alias("morning"))
    crowd = people.select(F.col("id").alias("node"), F.col("id").alias("idx"), F.lit(1).cast("bigint").alias("w"))
    who = pick(trips.withColumn("_p", uniform(seed, F.col("k"), "person")), "_p", crowd, "id").select("k", "morning", "id")
    rows = materialise(who.join(people.select("id", "home", "commute_min", "mode"), "id"), "drawn")
    found = rows.join(gaussian_pairs(rows, nodes, seed), "k")
    leave = lambda arrival: clock.departure(F.col("commute_min"), start, end, arrival)
    turned = lambda a, b: F.when(F.col("morning"), F.col(a)).otherwise(F.col(b))
    return found.select(
        "id", "k", turned("origin", "destination").alias("origin"), turned("destination", "origin").alias("destination"), F.when(F.col("morning"), "HBW_AM").otherwise("HBW_PM").alias("purpose"),
        F.when(F.col("morning"), leave(ARRIVE_WORK)).otherwise(leave(ARRIVE_HOME)).alias("departure_time_s"), "mode", F.lit("gravity").alias("dest_source"),
    )


def census_trips(people: DataFrame, nodes: DataFrame, n_am: int, n_pm: int, seed: int, start: int, end: int) -> DataFrame:
    """All trips of both peaks: scheduled people (``work`` is not null and not ``home``) first, what the budgets leave by ``fallback_trips``."""
    people, nodes = _kept(people, nodes)
    ready = people.where("work IS NOT NULL AND work <> home")
    parts = [materialise(schedule_trips(ready, budget, morning, start, end), "scheduled") for budget, morning in ((n_am, True), (n_pm, False)) if budget]
    made = [p.count() for p in parts]
    left = [budget - n for budget, n in zip([b for b in (n_am, n_pm) if b], made)]
    rest_am, rest_pm = (left[0] if n_am else 0), (left[-1] if n_pm else 0)
    far = _drawn_trips(people, nodes, rest_am, rest_pm, seed, start, end)
    columns = ["origin", "destination", "purpose", "departure_time_s", "mode", "dest_source"]
    whole = far.select(*columns)
    for p in parts:
        whole = whole.union(p.select(*columns))
    return whole
