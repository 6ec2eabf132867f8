"""Stages of bundle validation, and pages against the plain fold."""

import random

from corridor.operators import bundles, pages

KINDS = {
    "bundles": "bundle string", "manifests": "bundle string, parsed boolean, root string, has_scenario boolean, scenario_id string, has_files boolean",
    "entries": "bundle string, type string, path string, required boolean, sha256 string", "disk": "bundle string, path string, sha256 string",
    "configs": "bundle string, parsed boolean, root string, has_metadata boolean, scenario_id string, has_units boolean, length string, speed string, time string",
    "networks": "bundle string, parsed boolean, root string, has_metadata boolean, length string, speed string, has_nodes boolean", "nodes": "bundle string, pos long, node string",
    "signals": "bundle string, parsed boolean, root string", "headers": "bundle string, columns array<string>", "trips": "bundle string, row_no long, trip_id string, origin string, destination string, departure string",
}


def _good(name):
    return {
        "bundles": [(name,)], "manifests": [(name, True, "manifest", True, "s", True)], "entries": [(name, t, t, True, "h" if t == "demand" else None) for t in bundles.TYPES],
        "disk": [(name, t, "h") for t in bundles.TYPES], "configs": [(name, True, "config", True, "s", True, "m", "m/s", "s")], "networks": [(name, True, "network", True, "m", "m/s", True)],
        "nodes": [(name, 1, "a"), (name, 2, "b")], "signals": [(name, True, "signals")], "headers": [(name, list(bundles.COLUMNS))], "trips": [(name, 2, "t1", "a", "b", "5"), (name, 3, "t2", "b", "a", " 0 ")],
    }


#: What each bundle changes in a good one, and what is found then.
CASES = {
    "good": ({}, []),
    "no manifest": ({"manifests": [], "trips": []}, [(1, "manifest_missing", 0, None)]),
    "unreadable": ({"manifests": [("", False, None, None, None, None)], "configs": [("", False, *[None] * 7)]}, [(1, "manifest_unreadable", 0, None)]),
    "two networks": ({"entries": [("", t, t, True, None) for t in ("network", "network", "demand", "config")], "signals": []}, [(1, "type_missing", 0, "signals"), (1, "type_repeated", 0, "network")]),
    "lost files": ({"disk": [("", "demand", "other")], "trips": []}, [(1, "file_missing", 0, t) for t in ("config", "network", "signals")] + [(1, "hash", 0, "demand")]),
    "optional": ({"entries": [("", t, t, t != "signals", None) for t in bundles.TYPES], "disk": [("", t, "h") for t in bundles.TYPES[:3]], "signals": []}, []),
    "bad config": ({"configs": [("", False, *[None] * 7)], "networks": [("", False, *[None] * 5)]}, [(2, "config_unreadable", 0, None)]),
    "other ids": ({"configs": [("", True, "config", True, "x", True, "ft", "", "s")], "trips": [("", 2, "t", "a", "a", "-1")]}, [(2, "config_unit", 0, None), (2, "scenario_ids_differ", 0, None), (3, "length_units_differ", 0, None), (7, "departure_negative", 2, None), (7, "self_loop", 2, None)]),
    "bad network": ({"networks": [("", False, *[None] * 5)], "signals": [("", False, None)]}, [(3, "network_unreadable", 0, None)]),
    "no nodes": ({"nodes": [("", 1, ""), ("", 2, None)], "signals": [("", True, "x")]}, [(3, "node_id", 1, None), (3, "node_id", 2, None), (4, "signals_root", 0, None), (5, "no_nodes", 0, None)]),
    "columns": ({"headers": [("", ["mode", "trip_id", "origin_node_id", "x"])], "trips": []}, [(6, "columns", 0, "departure_time_s, destination_node_id")]),
    "no header": ({"headers": [("", None)]}, [(6, "header", 0, "")]),
    "rows": (
        {"nodes": [("", 1, "a"), ("", 5, "b"), ("", 7, "a")], "trips": [("", 2, "t", "a", "b", "1"), ("", 3, " t ", "c", "b", "x"), ("", 4, None, "a", None, "1.5")]},
        [(3, "node_repeated", 7, "a"), (7, "departure", 3, None), (7, "departure", 4, None), (7, "destination", 4, None), (7, "origin", 3, None), (7, "trip_id", 4, None), (7, "trip_repeated", 3, None)],
    ),
    "no trips": ({"trips": []}, [(7, "no_trips", 0, None)]),
}


def test_stages(spark):
    rows = {k: [] for k in KINDS}
    for name, (changed, _) in CASES.items():
        for k, own in (_good(name) | {k: [(name, *r[1:]) for r in v] for k, v in changed.items()}).items():
            rows[k] += own
    facts = bundles.Bundles(**{k: spark.createDataFrame(v, KINDS[k]) for k, v in rows.items()})
    found = {name: [] for name in CASES}
    for r in bundles.violations(facts).collect():
        found[r["bundle"]].append((r["stage"], r["rule"], r["row_no"], r["key"]))
    want = {name: sorted(v, key=str) for name, (_, v) in CASES.items()}
    got = {name: sorted(((s, r, n, k if (s, r) not in {(6, "header")} else "") for s, r, n, k in v), key=str) for name, v in found.items()}
    assert got == want
    valid = {r["bundle"]: r["valid"] for r in bundles.verdicts(facts, bundles.violations(facts)).collect()}
    assert {n for n, v in valid.items() if v} == {"good", "optional"}


def test_pages_are_those_of_the_fold(spark):
    rnd = random.Random(1)
    reports = {"a": [rnd.randint(0, 30) for _ in range(4_000)], "b": [rnd.choice((1, 200)) for _ in range(60)], "c": [5], "d": [18] * 25}
    room = {"a": 77, "b": 60, "c": 20, "d": 20}
    want = []
    for key, widths in reports.items():
        page, used = 1, 0
        for i, w in enumerate(widths):
            if used and used + w + 2 > room[key]:
                page, used = page + 1, 0
            used += w + 2
            want.append((key, i * 3, page))
    columns = spark.createDataFrame([(k, i * 3, w) for k, ws in reports.items() for i, w in enumerate(ws)], "report string, pos long, width int").repartition(5)
    rooms = spark.createDataFrame(list(room.items()), "report string, room int")
    assert sorted(map(tuple, pages.packed(columns, rooms, "report").collect())) == sorted(want)
    assert pages.packed(columns.limit(0), rooms, "report").count() == 0
