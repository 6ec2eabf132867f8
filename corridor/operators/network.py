"""Directed multigraphs: degrees, first links, turn restrictions, reach and the largest strong component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.operators import runs
from corridor.operators.components import strong_components
from corridor.session import materialise


def degree(links: DataFrame) -> DataFrame:
    """In- and outgoing links of each node, self-loops left out."""
    real = links.where("from_node <> to_node")
    ends = real.select(F.col("from_node").alias("node")).union(real.select(F.col("to_node").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def link_index(links: DataFrame) -> DataFrame:
    """The first link (by ``link_pos``) of each node in five ways: into it, out of it to a node that goes on, touching it, out of it, and into it again.

    ``goes_on`` tells whether a link leaves the node.
    """
    first = lambda cond=None: F.min(F.when(cond, F.struct("link_pos", "link_id")) if cond is not None else F.struct("link_pos", "link_id"))
    sources = links.select(F.col("from_node").alias("to_node")).distinct().withColumn("_on", F.lit(True))
    rows = links.join(sources, "to_node", "left")
    ends = rows.select(F.col("from_node").alias("node"), F.lit("out").alias("end"), "link_pos", "link_id", "_on").union(rows.select(F.col("to_node").alias("node"), F.lit("in").alias("end"), "link_pos", "link_id", "_on"))
    out, into = F.col("end") == "out", F.col("end") == "in"
    by = ends.groupBy("node").agg(
        first(into).alias("into"), first(out & F.col("_on")).alias("onward"), first().alias("touching"), first(out).alias("out"), F.bool_or(out).alias("goes_on")
    )
    return by.select("node", "goes_on", *(F.col(f"{c}.link_id").alias(c) for c in ("into", "onward", "touching", "out")))


def first_of_all(links: DataFrame) -> DataFrame:
    """The first link of the table, one row: where a node has none."""
    return links.agg(F.min(F.struct("link_pos", "link_id"))["link_id"].alias("fallback"))


def first_links(links: DataFrame) -> DataFrame:
    """The first outgoing link of each node, by position."""
    return links.groupBy(F.col("from_node").alias("node")).agg(F.min_by("link_id", "link_pos").alias("first_link"))


def forbidden_moves(restrictions: DataFrame, links: DataFrame) -> DataFrame:
    """``via_node, from_link, to_link`` that ``no_*`` rules name and that ``only_*`` rules leave out."""
    named = restrictions.where(F.col("type").startswith("no_")).select("via_node", "from_link", "to_link")
    out = links.select(F.col("from_node").alias("via_node"), F.col("link_id").alias("other"))
    only = restrictions.where(F.col("type").startswith("only_")).join(out, "via_node").where("other <> to_link")
    return named.union(only.select("via_node", "from_link", F.col("other").alias("to_link"))).distinct()


def length_histogram(links: DataFrame) -> DataFrame:
    """Links by length class with their share of all; class 0 is for lengths of 0 and unreadable ones alone."""
    x = F.coalesce(F.col("length"), F.lit(0.0))
    name = F.when(x == 0, "0").when(x < 0.1, "<0.1").when(x < 1, "<1").when(x < 10, "<10").when(x < 100, "<100").otherwise(">=100")
    by = links.groupBy(name.alias("bucket")).agg(F.count("*").alias("links"))
    total = by.agg(F.sum("links").alias("all_links"))  # one row
    return by.crossJoin(F.broadcast(total)).select("bucket", "links", (F.col("links") * 100.0 / F.col("all_links")).alias("percent"))


def hops(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, hops``: the least number of links from any source (``node``). One join a level; only the frontier moves."""
    edges = materialise(links.select(F.col("from_node").alias("node"), F.col("to_node").alias("to")).distinct(), "edges")
    found = materialise(sources.select("node").distinct().withColumn("hops", F.lit(0).cast("long")), "reach")
    frontier, level = found, 0
    while True:
        level += 1
        new = frontier.select("node").join(edges, "node").select(F.col("to").alias("node")).distinct().join(found, "node", "left_anti")
        frontier = materialise(new.withColumn("hops", F.lit(level).cast("long")), "frontier")
        if frontier.limit(1).count() == 0:
            return found
        found = found.union(frontier)
        if level % 8 == 0:
            found = materialise(found, "reach")


#: Rows of a frontier, by its growth so far, beyond which a search goes on in two halves of its pairs.
VISITED = 20_000_000
#: Tables of met states that become one.
MERGED = 8


def _kept(parts: list[tuple[int, DataFrame]], more: DataFrame) -> list[tuple[int, DataFrame]]:
    """``parts`` with ``more``; ``MERGED`` ones of a tier become one of the next, so that a row is written again by the logarithm of the levels."""
    parts = [*parts, (0, more)]
    while len(parts) >= MERGED and len({tier for tier, _ in parts[-MERGED:]}) == 1:
        tier = parts[-1][0] + 1
        parts = [*parts[:-MERGED], (tier, materialise(reduce(DataFrame.union, [df for _, df in parts[-MERGED:]]), "seen"))]
    return parts


def _union(parts: list[tuple[int, DataFrame]], *more: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [*(df for _, df in parts), *more])


def _extent(front: DataFrame) -> tuple[int, int | None, int | None]:
    """Rows of a frontier, its least and its greatest distance."""
    return tuple(front.agg(F.count("*"), F.min("dist"), F.max("dist")).first())


def _spread(front: DataFrame, left: DataFrame, arcs: DataFrame, seen: DataFrame, forward: bool, now: int, more: bool) -> DataFrame:
    """The next frontier of the ends that ``left`` still holds: states an arc beyond those at distance ``now``, each with its least way; the others stay where there are ``more``."""
    end, here, there = ("origin", "a", "b") if forward else ("destination", "b", "a")
    live = front.join(left.select(end).distinct(), end, "left_semi")
    step = live.where(F.col("dist") == now).withColumnRenamed("node", here).join(arcs, here)
    arc = F.array("arc")
    step = step.select(end, F.col(there).alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), (F.concat("at", arc) if forward else F.concat(arc, "at")).alias("at"), "tail")
    new = step.join(seen, [end, "node"], "left_anti")
    if more:
        new = new.union(live.where(F.col("dist") > now).select(*new.columns))
    new = new.groupBy(end, "node").agg(F.min(F.struct("dist", "at", "tail")).alias("way"))
    return materialise(new.select(end, "node", "way.*"), "frontier")


def _met(left: DataFrame, fronts: list[DataFrame], back: DataFrame, front_first: bool, bound: int | None) -> DataFrame:
    """``left`` with the least way met so far and ``done``: no way can be less, as it is within ``bound`` or one end has no state left to go on from.

    Pairs are spread by the smaller table.
    """
    back = back.select("destination", "node", F.col("dist").alias("far"), F.col("at").alias("rest"), "tail")
    alive = lambda side, end: fronts[side].select(end).distinct().withColumn(f"{end}_open", F.lit(True))
    pairs, front = left.select("origin", "destination"), fronts[0].drop("tail")
    both = pairs.join(front, "origin").join(back, ["destination", "node"]) if front_first else pairs.join(back, "destination").join(front, ["origin", "node"])
    least = both.groupBy("origin", "destination").agg(F.min(F.struct((F.col("dist") + F.col("far")).alias("dist"), F.concat("at", "rest").alias("at"), "tail")).alias("new"))
    found = left.join(least, ["origin", "destination"], "left").join(alive(0, "origin"), "origin", "left").join(alive(1, "destination"), "destination", "left")
    found = found.select("origin", "destination", F.least("way", "new").alias("way"), (F.col("origin_open") & F.col("destination_open")).isNull().alias("ended"))
    within = F.lit(True) if bound is None else F.coalesce(F.col("way.dist") <= bound, F.lit(False))
    return materialise(found.select("origin", "destination", "way", (F.col("ended") | within).alias("done")), "paths")


def _searched(arcs: DataFrame, left: DataFrame, fronts: list[DataFrame], seen: list[list[tuple[int, DataFrame]]], visited: int, before: int = -1, growth: tuple[float, float] = (1.0, 1.0), depth: int = 0) -> list[DataFrame]:
    """``origin, destination, way`` of the pairs ``left`` (with the least ``way`` met so far) that have a way over ``arcs`` (``arc, a, b, weight``), from both ends.

    ``fronts`` are the states an arc beyond those met (``seen``) by origin and by destination, with the distance, the
    arcs to (or from) there and the ``tail``. Each level meets the nearest states of the smaller one. The first state of a
    way that is not met from the origin is in its frontier; where the way is no longer than the least distances
    of both frontiers, that state is known from the destination, too, or the way ended within the arc behind its last
    state, which was in both tables before it was met. So the least of all ways through a state of both is the
    least one. All ways up to ``before`` are found.
    """
    found, extents, growth = [], [_extent(f) for f in fronts], list(growth)
    while extents[0][0]:
        (n, near, far), (m, back, _) = extents
        bound = near + back if m else None
        if bound is None or bound > before:
            behind = _union(seen[1], fronts[1]).where(F.col("dist") > before - far)
            met = _met(left, fronts, behind, n <= m, bound)
            found.append(met.where("done AND way IS NOT NULL").drop("done"))
            left, before = met.where("NOT done").drop("done"), bound
        if not m or left.isEmpty():
            return found
        side = 0 if n <= m else 1
        end = ("origin", "destination")[side]
        if extents[side][0] * growth[side] > visited and depth < 16 and left.select(end).distinct().limit(2).count() > 1:
            bit = F.shiftright(F.xxhash64(end), depth).bitwiseAND(1)
            for half in (0, 1):
                own = materialise(left.where(bit == half), "wanted")
                mine = list(fronts)
                mine[side] = materialise(fronts[side].join(own.select(end).distinct(), end, "left_semi"), "frontier")
                found += _searched(arcs, own, mine, list(seen), visited, before, tuple(growth), depth + 1)
            return found
        now, last = extents[side][1:]
        nearest = fronts[side].where(F.col("dist") == now)
        seen[side] = _kept(seen[side], nearest.select("origin", "node") if side == 0 else nearest)
        known = _union(seen[side]).select(end, "node")
        fronts[side] = _spread(fronts[side], left, arcs, known, side == 0, now, now < last)
        rows = max(1, extents[side][0])
        extents[side] = _extent(fronts[side])
        growth[side] = max(1.0, extents[side][0] / rows)
    return [*found, left.where("way IS NOT NULL")]


def _ways(edges: DataFrame, trips: DataFrame, start: Column, goals: DataFrame | None, visited: int) -> tuple[DataFrame, DataFrame, runs.Arcs]:
    """The ways of ``trips`` over ``edges`` (``node, next, pos, to``) from the state ``start`` of each origin to any of the ``goals`` (``destination, node``; without them: the destinations): those along one run, and those searched.

    Runs of states are one arc. A pair along one run has its way there (``origin, destination, end, arc, step``); others go from
    the end of the origin's run (of ``weight``, its arc ``first``) to the start of the destination's, the part of that being the
    way's ``tail``: ``origin, destination, run, step, first, weight, dist, at, tail``. States and arcs are numbers.
    """
    pairs = materialise(trips.where("origin <> destination").select("origin", "destination").distinct(), "pairs")
    states = materialise(edges.select("node").union(edges.select("next")).distinct().withColumn("state", F.monotonically_increasing_id()), "states")
    at = lambda name, new: states.select(F.col("node").alias(name), F.col("state").alias(new))
    moves = materialise(edges.join(at("node", "a"), "node").join(at("next", "b"), "next").where("a <> b").select("a", "b", "pos", "to"), "moves")
    network = runs.contracted(moves)
    arcs, inner = network.arcs, network.inner
    ends = pairs.select("destination").distinct()
    goals = ends.join(goals, "destination") if goals is not None else ends.select("destination", F.col("destination").alias("node"))
    of_run = arcs.where("run IS NOT NULL")
    goals = goals.join(states, "node").join(inner, "state", "left").join(of_run.select("run", "arc", "a"), "run", "left")
    goals = materialise(goals.select("destination", "state", "run", F.col("step").alias("end"), "arc", F.coalesce("a", "state").alias("node")), "goals")
    starts = pairs.select("origin").distinct().select("origin", start.alias("node")).join(states, "node").join(inner, "state", "left").join(of_run.select("run", "arc", "b", "weight"), "run", "left")
    starts = starts.select("origin", "run", "step", F.col("arc").alias("first"), "weight", F.coalesce("b", "state").alias("state"))
    key = goals.groupBy("destination").agg(F.min("state").alias("goal"))
    wanted = materialise(pairs.join(starts, "origin").join(key, "destination"), "wanted")
    along = wanted.where("run IS NOT NULL").join(goals.select("destination", "run", "end"), ["destination", "run"]).where("end > step")
    along = materialise(along.groupBy("origin", "destination").agg(F.min("end").alias("end"), F.first("first").alias("arc"), F.first("step").alias("step")), "along")
    rest = materialise(wanted.join(along, ["origin", "destination"], "left_anti"), "wanted")
    left = materialise(rest.select(F.col("state").alias("origin"), F.col("goal").alias("destination")).distinct(), "wanted")
    none = F.array().cast("array<bigint>").alias("at")
    front = left.select("origin").distinct().select("origin", F.col("origin").alias("node"), F.lit(0).cast("long").alias("dist"), none, F.lit(0).cast("long").alias("tail"))
    tail = F.coalesce("end", F.lit(0)).cast("long")
    back = goals.join(key, "destination").select(F.col("goal").alias("destination"), "node", F.struct(tail.alias("dist"), F.when(F.col("run").isNull(), none).otherwise(F.array("arc")).alias("at"), tail.alias("tail")).alias("way"))
    back = back.join(left.select("destination").distinct(), "destination", "left_semi").groupBy("destination", "node").agg(F.min("way").alias("way")).select("destination", "node", "way.*")
    fronts = [materialise(x, "frontier") for x in (front, back)]
    way = F.lit(None).cast("struct<dist: bigint, at: array<bigint>, tail: bigint>").alias("way")
    found = _union([], *_searched(arcs.where("a <> b").drop("run"), left.select("origin", "destination", way), fronts, [[], []], visited))
    found = rest.join(found.selectExpr("origin AS state", "destination AS goal", "way.*"), ["state", "goal"]).drop("state", "goal")
    return along, materialise(found, "found"), network


def _least_paths(edges: DataFrame, trips: DataFrame, start: Column, goals: DataFrame | None, visited: int) -> DataFrame:
    """``trips`` with ``path``, by a search as in ``_ways``; the names of the nodes come in at its end, a row a step."""
    along, found, network = _ways(edges, trips, start, goals, visited)
    whole = found.select("origin", "destination", F.posexplode("at").alias("k", "arc"), F.size("at").alias("n"), "tail").join(network.arcs.selectExpr("arc", "weight AS all"), "arc")
    whole = whole.selectExpr("origin", "destination", "k + 1 AS j", "arc", "1L AS low", "CASE WHEN tail > 0 AND k + 1 = n THEN tail ELSE all END AS high")
    pieces = along.selectExpr("origin", "destination", "0 AS j", "arc", "step + 1 AS low", "end AS high")
    pieces = pieces.union(found.where("run IS NOT NULL").selectExpr("origin", "destination", "0 AS j", "first AS arc", "step + 1 AS low", "weight AS high")).union(whole)
    named = pieces.select("origin", "destination", "j", "arc", F.explode(F.sequence("low", "high")).alias("step")).join(network.steps, ["arc", "step"])
    found = named.groupBy("origin", "destination").agg(F.sort_array(F.collect_list(F.struct("j", "step", "name"))).alias("way"))
    found = materialise(found.select("origin", "destination", F.col("way.name").alias("way")), "ways")
    path = F.when(F.col("origin") == F.col("destination"), F.array("origin")).when(F.col("way").isNotNull(), F.concat(F.array("origin"), F.col("way")))
    return trips.join(found, ["origin", "destination"], "left").select(*trips.columns, path.alias("path"))


def _plain_edges(links: DataFrame) -> DataFrame:
    """``node, next, pos, to``: nodes that links join, with the first link's position."""
    whole = links.where("link_id <> '' AND from_node <> '' AND to_node <> ''")
    edges = whole.groupBy(F.col("from_node").alias("node"), F.col("to_node").alias("next")).agg(F.min("link_pos").cast("long").alias("pos")).withColumn("to", F.col("next"))
    return materialise(edges, "edges")


def paths(links: DataFrame, trips: DataFrame, visited: int = VISITED) -> DataFrame:
    """All rows of ``trips`` (``origin, destination``) with ``path``, the nodes of a fewest-hop path.

    Of several, ``path`` is the one that a breadth-first search finds whose links are tried by ``link_pos``:
    a level's nodes are visited in the order of their own paths, so it is the least by the positions of its
    links, the first one first. It is ``[origin]`` where both ends are equal, and null where there is no path
    or an end is null. The search goes from both ends and stops where they meet, so a trip visits the nodes
    of half its way; a level is one join, and only the frontiers carry paths.
    """
    return _least_paths(_plain_edges(links), trips, F.col("origin"), None, visited)


def hop_counts(links: DataFrame, trips: DataFrame, visited: int = VISITED) -> DataFrame:
    """All rows of ``trips`` with ``hops``, the links of the path in ``paths``; no path is made."""
    along, found, _ = _ways(_plain_edges(links), trips, F.col("origin"), None, visited)
    hops = along.selectExpr("origin", "destination", "end - step AS hops").union(found.selectExpr("origin", "destination", "dist + IF(run IS NULL, 0, weight - step) AS hops"))
    return trips.join(hops, ["origin", "destination"], "left").select(*trips.columns, F.when(F.col("origin") == F.col("destination"), F.lit(0)).otherwise(F.col("hops")).cast("long").alias("hops"))


def largest_component(links: DataFrame) -> DataFrame:
    """Nodes of the largest strongly connected component; ties go to the smallest node id."""
    found = materialise(strong_components(links), "components")
    largest = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return materialise(found.join(F.broadcast(largest), "component").select("node"), "component")  # one row


def ranked_classes(links: DataFrame) -> DataFrame:
    """``road, n, first_pos, place``: classes by falling count, the first seen first. The window holds one row a class."""
    by = links.groupBy("road").agg(F.count("*").alias("n"), F.min("link_pos").alias("first_pos"))
    return by.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "first_pos")))


def class_table(links: DataFrame, most: int = 12) -> DataFrame:
    """``links`` with ``class``: its road class, or one name for all classes beyond the first ``most``."""
    classes = ranked_classes(links)
    others = classes.where(F.col("place") > most).agg(F.count("*").alias("k"))  # one row
    named = classes.crossJoin(F.broadcast(others)).select("road", F.when(F.col("place") <= most, F.col("road")).otherwise(F.concat(F.lit("(other x "), "k", F.lit(")"))).alias("class"))
    return links.join(named, "road")


def degenerate_counts(links: DataFrame) -> DataFrame:
    """Links, self-loops, others without a length, and what is left."""
    loop, flat = F.col("from_node") == F.col("to_node"), F.col("length") <= 0
    n = lambda c: F.count(F.when(c, 1))
    return links.agg(F.count("*").alias("links"), n(loop).alias("self_loops"), n(~loop & flat).alias("no_length"), n(~loop & ~flat).alias("kept"))


def links_of_steps(steps: DataFrame, links: DataFrame) -> DataFrame:
    """``path, pos, link_id`` of each pair of nodes in a row (``path, pos, node``): the first link between them, null without one."""
    order = W.partitionBy("path").orderBy("pos")
    pairs = steps.withColumn("to_node", F.lead("node").over(order)).where("to_node IS NOT NULL").withColumnRenamed("node", "from_node")
    first = links.groupBy("from_node", "to_node").agg(F.min_by("link_id", "link_pos").alias("link_id"))
    return pairs.join(first, ["from_node", "to_node"], "left").select("path", "pos", "link_id")


def link_paths(tied: DataFrame) -> DataFrame:
    """``path, links`` of the paths whose every step has a link."""
    by = tied.groupBy("path").agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.when(F.col("link_id").isNotNull(), F.struct("pos", "link_id")))).alias("s"))
    return by.where("size(s) = k").select("path", F.transform("s", lambda x: x["link_id"]).alias("links"))


def with_endpoints(links: DataFrame, nodes: DataFrame, metric: DataFrame) -> DataFrame:
    """Links with the places of both ends, and a metric that is 0 where a link has none."""
    end = lambda k, name: nodes.select(F.col("node").alias(name), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    both = links.join(end(1, "from_node"), "from_node").join(end(2, "to_node"), "to_node").join(metric, "link_id", "left")
    return both.select("link_id", "x1", "y1", "x2", "y2", F.coalesce("volume", F.lit(0)).alias("volume"))


def restricted_paths(links: DataFrame, trips: DataFrame, forbidden: DataFrame, visited: int = VISITED) -> DataFrame:
    """``trips`` with ``path``: a fewest-hop path that makes no forbidden move (``via_node, from_link, to_link``), null without one.

    A state is a node and, only where a rule forbids a move from it, the link that led there (the
    last one between two nodes): other links leave the same ways open, so they share a state. The
    first move is free. Of several paths it is the one a search finds that tries nodes by
    ``link_pos``, and it is searched from both ends, as in ``paths``.
    """
    whole = links.where("link_id <> '' AND from_node <> '' AND to_node <> ''")
    edges = whole.groupBy(F.col("from_node").alias("node"), F.col("to_node").alias("to")).agg(F.min("link_pos").cast("long").alias("pos"), F.max_by("link_id", "link_pos").alias("link"))
    bad = forbidden.select(F.col("via_node").alias("node"), F.col("from_link").alias("last"), F.col("to_link").alias("link")).distinct()
    bad = materialise(bad.join(edges.select("node", "link"), ["node", "link"], "left_semi"), "forbidden")
    ruled = bad.select(F.col("node").alias("to"), F.col("last").alias("link"), F.lit(True).alias("ruled")).distinct()
    edges = edges.join(ruled, ["to", "link"], "left").select("node", "to", "pos", "link", F.when(F.col("ruled"), F.col("link")).otherwise("").alias("state"))
    edges = materialise(edges, "edges")
    state = lambda node, last: F.struct(F.col(node).alias("node"), last.alias("last"))
    states = edges.select(F.col("to").alias("node"), F.col("state").alias("last")).union(edges.select("node", F.lit(""))).distinct()
    moves = edges.join(states, "node").join(bad, ["node", "last", "link"], "left_anti")
    moves = materialise(moves.select(state("node", F.col("last")).alias("node"), state("to", F.col("state")).alias("next"), "pos", "to"), "moves")
    goals = edges.select(F.col("to").alias("destination"), state("to", F.col("state")).alias("node")).distinct()
    return _least_paths(moves, trips, state("origin", F.lit("")), goals, visited)


def routes(links: DataFrame, trips: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``trips`` with ``path``: under the restrictions, else without them, else empty."""
    kept = restricted_paths(links, trips, forbidden)
    plain = paths(links, kept.where("path IS NULL AND origin IS NOT NULL AND destination IS NOT NULL").select("origin", "destination").distinct()).withColumnRenamed("path", "plain")
    return kept.join(plain, ["origin", "destination"], "left").select(*trips.columns, F.coalesce("path", "plain", F.array().cast("array<string>")).alias("path"))
