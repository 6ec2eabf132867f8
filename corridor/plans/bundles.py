"""Validation of whole bundles, and pages of wide reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import views
from corridor.operators import bundles, pages
from corridor.registry import query
from corridor.session import materialise

#: Bundles of the orders of some customers, an order in five of each kind of file; every rule has bundles that break it.
_B = "o_custkey % 300"
_KIND = "CASE o_orderkey % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'demand' WHEN 2 THEN 'config' WHEN 3 THEN 'signals' END"
_MANIFEST = ["bundle", "bundle % 17 <> 6 AS parsed", "CASE WHEN bundle % 23 = 3 THEN 'bundle' ELSE 'manifest' END AS root", "bundle % 29 <> 8 AS has_scenario", "CASE WHEN bundle % 19 <> 4 THEN 'b' || bundle END AS scenario_id", "bundle % 31 <> 7 AS has_files"]
_ENTRY = ["bundle", "type", "bundle || '/' || coalesce(type, 'notes') AS path", "bundle % 41 <> 1 AS required", "CASE WHEN bundle % 7 <> 0 THEN '{sha}' END AS sha256"]
_CONFIG = ["bundle", "bundle % 27 <> 1 AS parsed", "CASE WHEN bundle % 26 = 2 THEN 'setup' ELSE 'config' END AS root", "bundle % 25 <> 3 AS has_metadata", "CASE bundle % 24 WHEN 4 THEN 'other' WHEN 5 THEN '' ELSE 'b' || bundle END AS scenario_id", "bundle % 22 <> 5 AS has_units", "CASE WHEN bundle % 21 <> 6 THEN 'meters' END AS length", "'m/s' AS speed", "'seconds' AS time"]
_NETWORK = ["bundle", "bundle % 28 <> 7 AS parsed", "CASE WHEN bundle % 32 = 8 THEN 'graph' ELSE 'network' END AS root", "bundle % 33 <> 9 AS has_metadata", "CASE bundle % 12 WHEN 1 THEN 'miles' WHEN 2 THEN '' ELSE 'meters' END AS length", "CASE WHEN bundle % 16 = 3 THEN 'mph' ELSE 'm/s' END AS speed", "bundle % 34 <> 10 AS has_nodes"]
_SIGNALS = ["bundle", "bundle % 15 <> 11 AS parsed", "CASE WHEN bundle % 14 = 12 THEN 'lights' ELSE 'signals' END AS root"]
_NODE = [f"{_B} AS bundle", "o_orderkey AS pos", "CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE 'n' || (o_orderkey % 211) END AS node"]
_TRIP = [
    f"{_B} AS bundle", "o_orderkey AS row_no", "CASE WHEN o_orderkey % 43 = 0 THEN ' ' ELSE 't' || (o_orderkey % 401) END AS trip_id", "'n' || (o_orderkey % 211) AS origin", "'n' || (CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 211 ELSE o_custkey % 211 END) AS destination",
    "CASE o_orderkey % 9 WHEN 0 THEN 'late' WHEN 1 THEN '-5' WHEN 2 THEN '7.5' ELSE ' ' || (o_orderkey % 86400) || ' ' END AS departure",
]


def _facts(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    own = orders.selectExpr(f"{_B} AS bundle", f"{_KIND} AS type")
    files = own.groupBy("bundle", "type").agg(F.count("*").alias("n"))
    every = own.select("bundle").distinct()
    entries = files.where("NOT (type = 'signals' AND bundle % 37 = 2)")
    entries = entries.union(entries.where("type = 'network' AND bundle % 35 = 3"))
    sha = F.sha2(F.concat("type", F.when(F.col("bundle") % 36 == 4, "x").otherwise("")), 256)
    said = entries.select("bundle", "type", F.concat_ws("/", "bundle", F.coalesce("type", F.lit("notes"))).alias("path"), (F.col("bundle") % 41 != 1).alias("required"), F.when(F.col("bundle") % 7 != 0, sha).alias("sha256")).where("type IS NOT NULL OR bundle % 9 = 5")
    disk = files.where("type IS NOT NULL AND NOT (type = 'demand' AND bundle % 39 = 1)").select("bundle", F.concat_ws("/", "bundle", "type").alias("path"), F.sha2("type", 256).alias("sha256"))
    there = lambda kind, columns, cond="true": files.where(f"type = '{kind}'").where(cond).selectExpr(*columns)
    five = F.array(*map(F.lit, bundles.COLUMNS))
    headers = files.where("type = 'demand'").select("bundle", F.when(F.col("bundle") % 13 == 5, F.array_except(five, F.array(F.lit("mode"), F.lit("trip_id")))).when(F.col("bundle") % 13 != 6, five).alias("columns"))
    return bundles.Bundles(
        every, every.where("bundle % 18 <> 5").selectExpr(*_MANIFEST), said, disk, there("config", _CONFIG), there("network", _NETWORK), orders.where(f"{_B} % 38 <> 3").selectExpr(*_NODE), there("signals", _SIGNALS), headers,
        orders.where(f"{_B} % 20 <> 9").selectExpr(*_TRIP),
    )


_NO = "coalesce({0}, '') = ''".format
_FACTS = (
    f"ow AS (SELECT {_B} AS bundle, {_KIND} AS type FROM orders), fl AS (SELECT DISTINCT bundle, type FROM ow), ev AS (SELECT DISTINCT bundle FROM ow), ma AS (SELECT {', '.join(_MANIFEST)} FROM ev WHERE bundle % 18 <> 5), "
    "e1 AS (SELECT * FROM fl WHERE coalesce(NOT (type = 'signals' AND bundle % 37 = 2), true)), e2 AS (SELECT * FROM e1 UNION ALL SELECT * FROM e1 WHERE type = 'network' AND bundle % 35 = 3), "
    "en AS (SELECT bundle, type, bundle || '/' || coalesce(type, 'notes') AS path, bundle % 41 <> 1 AS required, CASE WHEN bundle % 7 <> 0 THEN sha256(type || CASE WHEN bundle % 36 = 4 THEN 'x' ELSE '' END) END AS sha256 FROM e2 WHERE type IS NOT NULL OR bundle % 9 = 5), "
    "dk AS (SELECT bundle, bundle || '/' || type AS path, sha256(type) AS found FROM fl WHERE type IS NOT NULL AND NOT (type = 'demand' AND bundle % 39 = 1)), "
    f"cf AS (SELECT {', '.join(_CONFIG)} FROM fl WHERE type = 'config'), nw AS (SELECT {', '.join(_NETWORK)} FROM fl WHERE type = 'network'), sg AS (SELECT {', '.join(_SIGNALS)} FROM fl WHERE type = 'signals'), "
    f"nd AS (SELECT {', '.join(_NODE)} FROM orders WHERE {_B} % 38 <> 3), tr AS (SELECT * REPLACE (trim(trip_id) AS trip_id, trim(departure) AS departure) FROM (SELECT {', '.join(_TRIP)} FROM orders WHERE {_B} % 20 <> 9)), "
    "gd AS (SELECT bundle FROM ma WHERE parsed), nn AS (SELECT nd.* FROM nd SEMI JOIN (SELECT * FROM nw WHERE parsed AND has_nodes) USING (bundle)), ni AS (SELECT DISTINCT bundle, node FROM nd WHERE node <> ''), hd AS (SELECT bundle, bundle % 13 AS h FROM fl WHERE type = 'demand'), "
)


def _rules(stage, source, checks, key="NULL", row_no="NULL"):
    return " UNION ALL ".join(f"SELECT bundle, {stage} AS stage, '{rule}' AS rule, CAST({row_no} AS BIGINT) AS row_no, CAST({key} AS VARCHAR) AS key FROM {source} WHERE {cond}" for rule, cond in checks.items())


_FOUND = " UNION ALL ".join(
    [
        _rules(1, "ev LEFT JOIN ma USING (bundle)", {"manifest_missing": "parsed IS NULL", "manifest_unreadable": "NOT parsed", "manifest_root": "parsed AND root <> 'manifest'", "manifest_scenario": "parsed AND NOT has_scenario", "manifest_files": "parsed AND NOT has_files", "manifest_scenario_id": f"parsed AND has_scenario AND {_NO('scenario_id')}"}),
        _rules(1, "en SEMI JOIN gd USING (bundle)", {"entry_type": "type IS NULL"}, "path"),
        _rules(1, "(SELECT bundle, w.type, count(en.type) AS n FROM gd CROSS JOIN (SELECT unnest(['network', 'demand', 'config', 'signals']) AS type) w LEFT JOIN en USING (bundle, type) GROUP BY ALL)", {"type_missing": "n = 0", "type_repeated": "n > 1"}, "type"),
        _rules(1, "(SELECT * FROM en SEMI JOIN gd USING (bundle) WHERE type IS NOT NULL) LEFT JOIN dk USING (bundle, path)", {"file_missing": "required AND found IS NULL", "hash": "sha256 <> found"}, "path"),
        _rules(2, "cf LEFT JOIN (SELECT bundle, scenario_id AS own_id FROM ma WHERE parsed) USING (bundle)", {"config_unreadable": "NOT parsed", "config_root": "parsed AND root <> 'config'", "config_metadata": "parsed AND NOT has_metadata", "config_scenario_id": f"parsed AND has_metadata AND {_NO('scenario_id')}", "scenario_ids_differ": f"parsed AND has_metadata AND NOT {_NO('own_id')} AND NOT {_NO('scenario_id')} AND own_id <> scenario_id", "config_units": "parsed AND NOT has_units", "config_unit": f"parsed AND has_units AND ({_NO('length')} OR {_NO('speed')} OR {_NO('time')})"}),
        _rules(3, "nw LEFT JOIN (SELECT bundle, length AS ol, speed AS os FROM cf WHERE parsed AND has_units) USING (bundle)", {"network_unreadable": "NOT parsed", "network_root": "parsed AND root <> 'network'", "network_metadata": "parsed AND NOT has_metadata", "network_unit": f"parsed AND has_metadata AND ({_NO('length')} OR {_NO('speed')})", "network_nodes": "parsed AND NOT has_nodes", "length_units_differ": "parsed AND has_metadata AND length <> '' AND ol <> '' AND length <> ol", "speed_units_differ": "parsed AND has_metadata AND speed <> '' AND os <> '' AND speed <> os"}),
        _rules(3, "nn", {"node_id": "node = ''"}, row_no="pos"),
        _rules(3, "(SELECT *, row_number() OVER (PARTITION BY bundle, node ORDER BY pos) AS k FROM nn)", {"node_repeated": "node <> '' AND k > 1"}, "node", "pos"),
        _rules(4, "sg", {"signals_unreadable": "NOT parsed", "signals_root": "parsed AND root <> 'signals'"}),
        _rules(5, "ev ANTI JOIN (SELECT * FROM nn WHERE node <> '') USING (bundle)", {"no_nodes": "true"}),
        _rules(6, "hd", {"header": "h = 6"}),
        _rules(6, "hd", {"columns": "h = 5"}, "'mode, trip_id'"),
        _rules(7, "(SELECT tr.*, a.node AS o, b.node AS d, CASE WHEN regexp_full_match(departure, '[+-]?\\d+') THEN TRY_CAST(departure AS BIGINT) END AS x FROM tr LEFT JOIN ni a ON a.bundle = tr.bundle AND a.node = origin LEFT JOIN ni b ON b.bundle = tr.bundle AND b.node = destination)", {"trip_id": "trip_id = ''", "self_loop": "origin = destination", "origin": "o IS NULL", "destination": "d IS NULL", "departure": "x IS NULL", "departure_negative": "x < 0"}, row_no="row_no"),
        _rules(7, "(SELECT *, row_number() OVER (PARTITION BY bundle, trip_id ORDER BY row_no) AS k FROM tr)", {"trip_repeated": "trip_id <> '' AND k > 1"}, row_no="row_no"),
        _rules(7, "ev ANTI JOIN tr USING (bundle)", {"no_trips": "true"}),
    ]
)
_ALL = f"WITH {_FACTS} al AS ({_FOUND}), st AS (SELECT bundle, min(stage) AS stop FROM al WHERE stage = 1 OR rule IN ('config_unreadable', 'network_unreadable', 'no_nodes', 'header', 'columns') GROUP BY bundle), vi AS (SELECT al.* FROM al LEFT JOIN st USING (bundle) WHERE stop IS NULL OR stage <= stop) "


@query("val_bundle", _ALL + "SELECT bundle, CAST(stage AS INTEGER) AS stage, rule, coalesce(row_no, 0) AS row_no, key FROM vi")
def val_bundle(spark, sf_dir):
    return bundles.violations(_facts(spark, sf_dir))


@query("val_bundle_verdicts", _ALL + "SELECT bundle, count(vi.stage) = 0 AS valid, count(vi.stage) AS findings FROM ev LEFT JOIN vi USING (bundle) GROUP BY bundle")
def val_bundle_verdicts(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return bundles.verdicts(facts, materialise(bundles.violations(facts), "violations"))


#: Columns of a report by nation: a customer each, some wider than a page.
_WIDE = "c_nationkey AS report, CAST(c_custkey AS BIGINT) AS pos, CASE WHEN c_custkey % 41 = 0 THEN 150 ELSE greatest(length(c_mktsegment), c_custkey % 23) END AS width"
_PAGES = (
    f"WITH RECURSIVE co AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY pos) AS k FROM (SELECT {_WIDE} FROM customer)), av AS (SELECT n_nationkey AS report, greatest(20, 100 - 2 - length(n_name)) AS room FROM nation), "
    "fold AS (SELECT co.report, k, pos, width + 2 AS used, CAST(1 AS BIGINT) AS page, room FROM co JOIN av USING (report) WHERE k = 1 UNION ALL "
    "SELECT f.report, c.k, c.pos, CASE WHEN used + c.width + 2 > room THEN c.width + 2 ELSE used + c.width + 2 END, CASE WHEN used + c.width + 2 > room THEN page + 1 ELSE page END, room FROM fold f JOIN co c ON c.report = f.report AND c.k = f.k + 1) "
)


@query("win_page_pack", _PAGES + "SELECT report, pos, page FROM fold")
def win_page_pack(spark, sf_dir):
    columns = views.table(spark, sf_dir, "customer").selectExpr(*_WIDE.split(", ", 2))
    rooms = views.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS report", "greatest(20, 100 - 2 - length(n_name)) AS room")
    return pages.packed(columns, rooms, "report")
