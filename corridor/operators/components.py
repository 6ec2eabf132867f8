"""Strong components by nested blocks: the number of jobs follows the logarithm of the network's size, not its diameter.

A round cuts the nodes into blocks of neighbours of ``BLOCK`` nodes at most. A task searches one
block: its inner components become single nodes, and of the others only those stay that links
of other blocks touch, with a link wherever one reaches another inside the block (where most
nodes are touched, the block's own links stay instead). What is left is the next round's
network; a network of one block has no link outside. On the way back a block learns which of
its touched nodes went together outside and searches again with them joined, which gives every
node its component. Any way to cut is right; a good one keeps blocks together, so that few of
their nodes are touched.

Nodes without a way in or without a way out are components of their own and go first. Runs of
nodes with one way in and one way out become a link each, by pointers of pointers, so long
ways cost the logarithm of their length. Where few hops reach much of a network (links without neighbourhood, which no cut keeps together),
a search both ways from the busiest node finds most of its component; that becomes one node
before the rounds. A network that rounds hardly shrink is searched hop by hop from its busiest nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.session import materialise

#: Nodes of a block at most.
BLOCK = 4096
#: The share of touched nodes up to which a block is replaced by its reach.
TOUCHED = 0.25
#: Hops of the search before the rounds at most, and how much each must find of what the one before found.
CORE_HOPS, CORE_GROWTH = 16, 2
#: Runs become links again where they made at least this share of the nodes.
RUNS = 0.1
#: A round that leaves more than this share of the nodes is the last.
SHRINK = 0.9


def _searched_block(nodes: Iterable[str], edges: dict[str, list[str]]) -> list[list[str]]:
    """Strong components of a block, sinks first."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, held, out = [], set(), []
    for root in nodes:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        walk = [(root, iter(edges.get(root, ())))]
        while walk:
            node, ways = walk[-1]
            for to in ways:
                if to not in order:
                    order[to] = low[to] = len(order)
                    stack.append(to)
                    held.add(to)
                    walk.append((to, iter(edges.get(to, ()))))
                    break
                if to in held:
                    low[node] = min(low[node], order[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(stack.pop())
                        held.discard(own[-1])
                    out.append(own)
    return out


def _ways(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def _reached(start: str, edges: dict[str, list[str]]) -> set[str]:
    seen, left = {start}, [start]
    while left:
        for to in edges.get(left.pop(), ()):
            if to not in seen:
                seen.add(to)
                left.append(to)
    return seen


_ROWS = "block string, kind string, x string, y string"


def _table(block: str, rows: list[tuple[str, str, str | None]]) -> pa.Table:
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
    return pa.table([pa.array([block] * len(rows), pa.string()), *columns], ["block", "kind", "x", "y"])


def _up(table: pa.Table) -> pa.Table:
    """Of a block's links (``e``) and touched nodes (``t``): each node's inner component (``m``), their links (``c``), and those of the next round (``n``)."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y"))))
    pairs = [(x, y) for k, x, y in rows if k == "e"]
    nodes = sorted({x for _, x, _ in rows} | {y for _, y in pairs})
    home = {node: min(own) for own in _searched_block(nodes, _ways(pairs)) for node in own}
    inner = {(home[a], home[b]) for a, b in pairs if home[a] != home[b]}
    touched = {home[x] for k, x, _ in rows if k == "t"}
    edges, passed = _ways(inner), inner
    if len(touched) <= TOUCHED * len(set(home.values())):
        passed = {(a, b) for a in touched for b in _reached(a, edges) & touched if a != b}
    found = [("m", a, b) for a, b in home.items()] + [("c", a, b) for a, b in inner] + [("n", a, b) for a, b in passed]
    return _table(table.column("block")[0].as_py(), found)


def _down(table: pa.Table) -> pa.Table:
    """The labels (``l``) of a block's inner components (``m``), by their links (``c``) and the labels that touched ones have (``l``)."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y"))))
    labels = {x: y for k, x, y in rows if k == "l"}
    pairs = [(x, y) for k, x, y in rows if k == "c"]
    first: dict[str, str] = {}
    last: dict[str, str] = {}
    for node, label in labels.items():  # what went together outside is joined to a ring
        if label in last:
            pairs.append((last[label], node))
        first.setdefault(label, node)
        last[label] = node
    pairs += [(last[label], node) for label, node in first.items() if last[label] != node]
    nodes = sorted({y for k, _, y in rows if k == "m"})
    found = []
    for own in _searched_block(nodes, _ways(pairs)):
        label = min((labels[x] for x in own if x in labels), default=min(own))
        found += [("l", x, label) for x in own]
    return _table(table.column("block")[0].as_py(), found)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """The links between nodes that have a way in and a way out."""
    both = edges.select(F.col("a").alias("node")).intersect(edges.select(F.col("b").alias("node")))
    return edges.join(both.withColumnRenamed("node", "a"), "a", "left_semi").join(both.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def _cut(nodes: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """``node, block``: neighbours joined, each to the one of least hash, until blocks are large; too large ones are split by hash."""
    left, labels = edges, nodes.withColumn("block", F.col("node"))
    for k in range(max(1, math.ceil(math.log(block / 8, 4)))):  # each joins about four; blocks are an eighth full, on average
        hashed = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))
        ways = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ways.groupBy("a").agg(F.min(hashed("b")).alias("best")).select("a", F.when(F.col("best") < hashed("a"), F.col("best.id")).otherwise(F.col("a")).alias("to"))
        step = materialise(step, "step")
        for _ in range(2):  # along the pointers of pointers
            step = step.join(step.select(F.col("a").alias("to"), F.col("to").alias("then")), "to").select("a", F.col("then").alias("to"))
        step = materialise(step, "steps")
        labels = labels.join(step.withColumnRenamed("a", "block"), "block", "left").select("node", F.coalesce("to", "block").alias("block"))
        at = lambda end: step.select(F.col("a").alias(end), F.col("to").alias(f"{end}2"))
        left = materialise(left.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "joined")
    labels = materialise(labels, "blocks")
    sizes = labels.groupBy("block").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return labels.join(sizes, "block").select("node", F.when(F.col("parts") > 1, F.concat_ws("/", "block", part)).otherwise(F.col("block")).alias("block"))


def _by_search(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes that links touch, one component after another: the slow way."""
    from corridor.operators.network import hops

    done = _ends(edges).select("node", F.col("node").alias("label")).limit(0)
    while True:
        lone = _ends(edges)
        edges = materialise(_trimmed(edges), "edges")
        done = materialise(done.union(lone.join(_ends(edges), "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
        pivot = edges.groupBy(F.col("a").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")
        if pivot.isEmpty():
            return done
        pivot = materialise(pivot, "pivot")
        ways = edges.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
        back = ways.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))
        found = materialise(hops(ways, pivot).select("node").intersect(hops(back, pivot).select("node")), "component")
        done = done.union(found.crossJoin(F.broadcast(pivot.withColumnRenamed("node", "label"))))  # one row
        inside = lambda end: found.withColumnRenamed("node", end)
        edges = edges.join(inside("a"), "a", "left_anti").join(inside("b"), "b", "left_anti").select("a", "b")


def _core(edges: DataFrame) -> DataFrame:
    """``node, label``: nodes that a search of few hops finds both from and to the busiest node, which is the label; all are of its component.

    The search ends where hops no longer widen, unless it has found half of the nodes both ways.
    """
    n = _ends(edges).count()
    pivot = edges.groupBy(F.col("a").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")
    pivot = materialise(pivot, "pivot")
    ways = materialise(edges.select(F.lit(True).alias("ahead"), F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.lit(False), "b", "a")), "ways")
    front = materialise(pivot.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead"), "node"), "front")
    found, seen, last, hop = front, 2, 2, 0
    while last and hop < CORE_HOPS:
        new = front.join(ways, ["ahead", "node"]).select("ahead", F.col("to").alias("node")).distinct().join(found, ["ahead", "node"], "left_anti")
        front = materialise(new, "front")
        k, hop = front.count(), hop + 1
        found, seen = found.union(front), seen + k
        if k < CORE_GROWTH * last and seen < n:
            break
        last = k
    both = found.groupBy("node").agg(F.count("*").alias("k")).where("k = 2").select("node")
    return materialise(both.crossJoin(F.broadcast(pivot.withColumnRenamed("node", "label"))), "core")  # one row


def _without_runs(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The links with one for each run of nodes that have one way in and one way out, ``node, run`` of those nodes, and ``run, x, y``, where a run comes from and leads to.

    A run has the name of its last node. Tables of nodes are merged, so that none passes the driver. Closed rings without another node stay as they are. None where runs are few.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    ways = materialise(ends.groupBy("node").agg(((F.sum("out") == 1) & (F.sum("into") == 1)).alias("plain")), "ways")
    n, plain = ways.agg(F.count("*"), F.count_if("plain")).first()  # two numbers
    if plain < max(1, RUNS * n):
        return None
    at = lambda end: ways.where("plain").select(F.col("node").alias(end), F.lit(True).alias(f"{end}_plain"))
    marked = materialise(edges.join(at("a").hint("merge"), "a", "left").join(at("b").hint("merge"), "b", "left").select("a", "b", F.col("a_plain").isNotNull().alias("a_plain"), F.col("b_plain").isNotNull().alias("b_plain")), "marked")
    # each node's pointer goes twice as far with a step; `last` where it can go no further
    step = marked.where("a_plain").select(F.col("a").alias("node"), F.when(F.col("b_plain"), F.col("b")).otherwise(F.col("a")).alias("to"), (~F.col("b_plain")).alias("last"))
    done, left = step.where("last").select("node", F.col("to").alias("run")), step.where("NOT last").select("node", "to")
    done, left = materialise(done, "runs"), materialise(left, "pointers")
    open_, before = left.count(), None
    while open_ and open_ != before:
        ahead = left.select(F.col("node").alias("to"), F.col("to").alias("then"))
        ended = done.select(F.col("node").alias("to"), "run")
        both = materialise(left.join(ahead.hint("merge"), "to", "left").join(ended.hint("merge"), "to", "left").select("node", "then", "run"), "pointers")
        done = done.union(both.where("run IS NOT NULL").select("node", "run"))
        left = both.where("run IS NULL").select("node", F.col("then").alias("to"))
        open_, before = left.count(), open_
    if plain - open_ < max(1, RUNS * n):
        return None
    runs = materialise(done, "runs")
    into = marked.where("b_plain AND NOT a_plain").join(runs.withColumnRenamed("node", "b"), "b").select("run", F.col("a").alias("x"))
    ways = materialise(into.join(marked.where("a_plain AND NOT b_plain").select(F.col("a").alias("run"), F.col("b").alias("y")), "run"), "runs")
    rest = marked.where("NOT a_plain AND NOT b_plain").select("a", "b").union(ways.where("x <> y").select("x", "y"))
    if open_:  # rings
        ring = left.select("node")
        rest = rest.union(marked.where("a_plain AND b_plain").join(ring.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b"))
    return materialise(rest.distinct(), "edges"), runs, ways


def _of_large(edges: DataFrame, block: int) -> DataFrame:
    """``node, label`` of a network of more than a block: runs of nodes and the core of its largest component become single ones before the rounds."""
    if _ends(edges).count() <= block:
        return _labels(edges, block)
    less = _without_runs(edges)
    if less is None:
        return _cored(edges, block)
    rest, runs, ways = less
    found = materialise(_of_large(rest, block), "labels")
    # a run goes with its ends where these are of one component
    of = lambda end: found.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    ends = ways.join(of("x"), "x", "left").join(of("y"), "y", "left").select("run", F.coalesce("x_label", "x").alias("x"), F.coalesce("y_label", "y").alias("y"))
    closed = ends.where("x = y").select("run", F.col("x").alias("label"))
    own = runs.join(closed, "run", "left").select("node", F.coalesce("label", "node").alias("label"))
    # a node that only runs back to itself touched is in no link now
    alone = ways.where("x = y").select(F.col("x").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("label"))
    return found.union(own).union(alone)


def _cored(edges: DataFrame, block: int) -> DataFrame:
    """``node, label``: the core goes first, then the rounds."""
    core, whole = _core(edges), edges
    for end in ("a", "b"):
        whole = whole.join(core.select(F.col("node").alias(end), F.col("label").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    rest = materialise(_trimmed(materialise(whole.where("a <> b").distinct(), "edges")), "edges")
    outer = materialise(_labels(rest, block), "labels")
    # a node of the core has the label that its one node got outside
    own = core.join(outer.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return own.union(outer.join(core, "node", "left_anti"))


def _labels(edges: DataFrame, block: int) -> DataFrame:
    """``node, label``: nodes of a component have the same one, the id of a node in it."""
    row = lambda df, b, kind, x, y: df.select(F.col(b).alias("block"), F.lit(kind).alias("kind"), F.col(x).alias("x"), y.cast("string").alias("y"))
    nodes = _ends(edges)
    n = nodes.count()
    if n <= block:
        whole = row(edges.withColumn("block", F.lit("all")), "block", "e", "a", F.col("b")).groupBy("block").applyInArrow(_up, _ROWS)
        return whole.where("kind = 'm'").select(F.col("x").alias("node"), F.col("y").alias("label"))
    blocks = _cut(nodes, edges, block)
    at = lambda end: blocks.select(F.col("node").alias(end), F.col("block").alias(f"{end}_block"))
    placed = materialise(edges.join(at("a"), "a").join(at("b"), "b"), "placed")
    inner, cross = placed.where("a_block = b_block"), placed.where("a_block <> b_block")
    none = F.lit(None)
    work = row(inner, "a_block", "e", "a", F.col("b")).union(row(cross, "a_block", "t", "a", none).union(row(cross, "b_block", "t", "b", none)).distinct())
    made = materialise(work.groupBy("block").applyInArrow(_up, _ROWS), "made")
    homes = made.where("kind = 'm'").select(F.col("x").alias("node"), F.col("y").alias("home"))
    to = lambda end: homes.select(F.col("node").alias(end), F.col("home").alias(f"{end}_home"))
    outside = cross.select("a", "b").join(to("a"), "a").join(to("b"), "b").select(F.col("a_home").alias("a"), F.col("b_home").alias("b"))
    graph = materialise(outside.union(made.where("kind = 'n'").select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b").distinct(), "edges")
    rest = materialise(_trimmed(graph), "edges")
    left = _ends(rest).count()
    above = _labels(rest, block) if 0 < left <= SHRINK * n else (_by_search(rest) if left else rest.select(F.col("a").alias("node"), F.col("a").alias("label")))
    known = made.where("kind = 'm'").select("block", F.col("y").alias("node")).distinct().join(above, "node")
    both = made.where("kind <> 'n'").union(known.select("block", F.lit("l").alias("kind"), F.col("node").alias("x"), F.col("label").alias("y")))
    found = materialise(both.groupBy("block").applyInArrow(_down, _ROWS), "labels")
    return homes.join(found.select(F.col("x").alias("home"), F.col("y").alias("label")), "home").select("node", "label")


def strong_components(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node, component`` of every node that a link joins to another: the least id in its strong component."""
    plain = links.where("from_node <> to_node").select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct()
    edges = materialise(plain, "edges")
    whole = materialise(_trimmed(edges), "edges")
    found = _of_large(whole, block)
    labels = materialise(_ends(edges).join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
