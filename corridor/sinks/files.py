"""The domain's documents: networks, demand, signals, configurations and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions import clock, identity
from corridor.sinks.lines import DECLARATION, block, document, element, escaped, fixed, section, text

_c = F.col


def network_xml(nodes: DataFrame, links: DataFrame, restrictions: DataFrame | None, crs: str) -> DataFrame:
    """The canonical network: nodes and links by id, restrictions by (via, from, to)."""
    spark = nodes.sparkSession
    node = element("node", {"id": _c("node"), "x": _c("x"), "y": _c("y"), "type": _c("type"), "osm_id": _c("osm_id"), "has_signal": F.when(_c("has_signal"), "true")})
    link = element(
        "link",
        {
            "id": _c("link_id"), "from": _c("from_node"), "to": _c("to_node"), "length": F.bround("length", 2), "lanes": _c("lanes"), "speed_limit": _c("speed"),
            "highway_type": _c("road"), "osm_way_id": _c("osm_way_id"), "name": _c("name"),
        },
    )
    head = f'  <metadata crs="{crs}" units_length="meters" units_speed="m/s" source="OSM"/>'
    parts = [text(spark, 0, "<network>", head, "  <nodes>"), section(1, nodes, _c("node"), node), text(spark, 2, "  </nodes>", "  <links>"), section(3, links, _c("link_id"), link), text(spark, 4, "  </links>")]
    if restrictions is not None:
        rule = element("turn_restriction", {"type": _c("type"), "from_link": _c("from_link"), "via_node": _c("via_node"), "to_link": _c("to_link")})
        parts += [text(spark, 5, "  <turn_restrictions>"), section(6, restrictions, F.concat_ws("\t", "via_node", "from_link", "to_link"), rule), text(spark, 7, "  </turn_restrictions>")]
    return document(*parts, text(spark, 8, "</network>"))


def sumo_nodes(nodes: DataFrame) -> DataFrame:
    line = element("node", {"id": _c("node"), "x": _c("x"), "y": _c("y"), "type": F.lit("priority")})
    return document(text(nodes.sparkSession, 0, DECLARATION, "<nodes>"), section(1, nodes, _c("node"), line), text(nodes.sparkSession, 2, "</nodes>"))


def _place(pos: Column) -> Column:
    return F.lpad(pos.cast("string"), 20, "0")


def sumo_edges(links: DataFrame) -> DataFrame:
    rows = links.where("from_node <> to_node")
    line = element("edge", {"id": _c("link_id"), "from": _c("from_node"), "to": _c("to_node"), "numLanes": _c("lanes"), "speed": _c("speed"), "length": fixed(_c("length"), 2)})
    return document(text(links.sparkSession, 0, DECLARATION, "<edges>"), section(1, rows, _place(_c("link_pos")), line), text(links.sparkSession, 2, "</edges>"))


def sumo_routes(trips: DataFrame, vtype: str) -> DataFrame:
    """Vehicles of the trips (``trip_id, depart, links``) that have a route."""
    spark = trips.sparkSession
    good = trips.where("size(links) > 0")
    key, id_ = _c("trip_id"), lambda p: F.concat(F.lit(p), "trip_id")
    vehicle = element("vehicle", {"id": id_("veh_"), "type": F.lit(vtype), "depart": _c("depart")}, 2, close=False)
    route = element("route", {"id": id_("r_"), "edges": F.array_join("links", " ")})
    return document(
        text(spark, 0, DECLARATION, "<routes>", sumo_vtype(vtype)),
        section(1, good, key, vehicle, 0), section(1, good, key, route, 1), section(1, good, key, F.lit("  </vehicle>"), 2), text(spark, 2, "</routes>"),
    )


#: The car's length, gap, width, speed, acceleration, deceleration and imperfection.
CAR = {"length": 5.0, "minGap": 2.5, "width": 1.8, "maxSpeed": 55.55, "accel": 2.6, "decel": 4.5, "sigma": 0.5}


def sumo_vtype(name: str) -> str:
    return f'  <vType id="{name}" vClass="passenger" ' + " ".join(f'{k}="{v}"' for k, v in CAR.items()) + "/>"


def sumo_vtypes(types: DataFrame) -> DataFrame:
    """A line for each type (``type, length``, that of the body), otherwise a car."""
    rest = {k: F.lit(str(v)) for k, v in CAR.items() if k != "length"}
    return document(section(0, types, _c("type"), element("vType", {"id": _c("type"), "vClass": F.lit("passenger"), "length": _c("length"), **rest}, 2)))


def matsim_vehicle_types(types: DataFrame) -> DataFrame:
    """A definition for each type (``type, length``): as long as its body and the gap before it."""
    spark = types.sparkSession
    one = block(
        1, types, _c("type"), element("vehicleType", {"id": _c("type")}, close=False), element("length", {"meter": fixed(_c("length") + CAR["minGap"], 1)}, 8), f'        <width meter="{CAR["width"]}"/>',
        f'        <maximumVelocity meterPerSecond="{CAR["maxSpeed"]}"/>', '        <passengerCarEquivalents pce="1.0"/>', '        <networkMode networkMode="car"/>', "    </vehicleType>",
    )
    return document(text(spark, 0, DECLARATION, '<vehicleDefinitions xmlns="http://www.matsim.org/files/dtd">'), one, text(spark, 2, "</vehicleDefinitions>"))


def matsim_network(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Capacity is 1800 vehicles an hour and lane; lengths are 1 m or more; self-loops are left out."""
    spark = nodes.sparkSession
    lanes = F.greatest(F.lit(1), _c("lanes"))
    link = element(
        "link",
        {
            "id": _c("link_id"), "from": _c("from_node"), "to": _c("to_node"), "length": fixed(F.greatest(F.lit(1.0), _c("length")), 2), "freespeed": fixed(_c("speed"), 2),
            "capacity": lanes * 1800, "permlanes": lanes, "modes": F.lit("car"),
        },
    )
    return document(
        text(spark, 0, DECLARATION, "<network>", "  <nodes>"), section(1, nodes, _c("node"), element("node", {"id": _c("node"), "x": _c("x"), "y": _c("y")})),
        text(spark, 2, "  </nodes>", '  <links capperiod="01:00:00">'), section(3, links.where("from_node <> to_node"), _place(_c("link_pos")), link), text(spark, 4, "  </links>", "</network>"),
    )


def matsim_plans(trips: DataFrame) -> DataFrame:
    """Persons of trips (``trip_id, depart, mode, origin_link, dest_link, links``): their route begins and ends on the links of their activities."""
    spark = trips.sparkSession
    first = F.when(F.coalesce(F.get("links", F.lit(0)) == _c("origin_link"), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array("origin_link"))
    rows = trips.withColumn("way", F.concat(first, F.coalesce("links", F.array().cast("array<string>"))))
    rows = rows.withColumn("way", F.when(F.element_at("way", -1) == _c("dest_link"), _c("way")).otherwise(F.concat("way", F.array("dest_link"))))
    quote = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lines = [
        quote('<person id="person_', _c("trip_id"), '">'),
        F.lit('  <plan selected="yes">'),
        quote('    <activity type="h" link="', _c("origin_link"), '" end_time="', clock.to_hms(_c("depart")), '"/>'),
        quote('    <leg mode="', _c("mode"), '">'),
        quote('      <route type="links" start_link="', F.element_at("way", 1), '" end_link="', F.element_at("way", -1), '">', F.array_join("way", " "), "</route>"),
        F.lit("    </leg>"),
        quote('    <activity type="w" link="', _c("dest_link"), '"/>'),
        F.lit("  </plan>"),
        F.lit("</person>"),
    ]
    body = rows.select("trip_id", F.posexplode(F.array(*lines)).alias("at", "line"))
    body = body.select(F.lit(1).alias("part"), F.col("trip_id").alias("key"), "at", "line")
    return document(text(spark, 0, DECLARATION, "<population>"), body, text(spark, 2, "</population>"))


def matsim_config(runs: DataFrame) -> DataFrame:
    """A configuration for each run (``run, seed, network, plans``)."""
    module = lambda name, key, value: F.concat(F.lit(f'  <module name="{name}"><param name="{key}" value="'), value.cast("string"), F.lit('"/></module>'))
    files = [module(k, "inputFile", _c(k)) for k in ("network", "plans")]
    return document(block(0, runs, _c("run"), DECLARATION, "<config>", module("global", "randomSeed", _c("seed")), *files, "</config>"))


def signals_xml(controllers: DataFrame) -> DataFrame:
    """Junctions by id, with their phases and the links of each."""
    spark = controllers.sparkSession
    rows = controllers.withColumn("id", F.concat(F.lit("tl_"), "node"))
    refs = F.transform(F.col("p.links"), lambda x: F.concat(F.lit('      <link_ref id="'), x, F.lit('"/>')))
    phase = rows.select("id", F.posexplode("phases").alias("k", "p"))
    opened = F.concat(F.lit('    <phase id="'), "p.phase", F.lit('" duration_s="'), "p.seconds", F.lit('" state="'), "p.state", F.lit('">'))
    inner = phase.select("id", "k", F.posexplode(F.concat(F.array(opened), refs, F.array(F.lit("    </phase>")))).alias("j", "line"))
    body = inner.select(F.lit(1).alias("part"), F.col("id").alias("key"), (F.col("k") * 100_000 + F.col("j") + 1).alias("at"), "line")
    head = element("junction", {"id": _c("id"), "node_id": _c("node"), "cycle_length_s": _c("cycle_s")}, 2, close=False)
    return document(text(spark, 0, DECLARATION, "<signals>"), section(1, rows, _c("id"), head, 0), body, section(1, rows, _c("id"), F.lit("  </junction>"), 2_000_000_000), text(spark, 2, "</signals>"))


def config_xml(scenarios: DataFrame) -> DataFrame:
    """A configuration for each scenario (``scenario_id, description, start, end, seed``)."""
    quote = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    return document(
        block(
            0, scenarios, _c("scenario_id"), DECLARATION, "<config>", element("metadata", {"scenario_id": _c("scenario_id")}, 2, close=False), quote("    <description>", escaped(_c("description")), "</description>"), "  </metadata>",
            element("time", {"start_time_s": _c("start"), "end_time_s": _c("end"), "time_step_s": F.lit(1)}, 2), element("random", {"seed": _c("seed"), "engine_seed_mode": F.lit("fixed")}, 2),
            '  <units length="meters" speed="m/s" time="seconds"/>', '  <simulation warmup_time_s="0" aggregation_interval_s="300"/>', "</config>",
        )
    )


def manifest_xml(files: DataFrame) -> DataFrame:
    """A manifest for each bundle (``scenario``) of its files (``type, path, sha256``), without a hash where a file is absent."""
    key = F.concat_ws("\t", "scenario", "type")
    line = element("file", {"type": _c("type"), "path": _c("path"), "sha256": _c("sha256")})
    bundles = files.select("scenario").distinct()
    head = block(0, bundles, F.concat("scenario", F.lit("\t")), DECLARATION, '<manifest version="0.2">', element("scenario", {"id": _c("scenario")}, 2), "  <canonical_files>")
    foot = block(0, bundles, F.concat("scenario", F.lit("\t~")), "  </canonical_files>", "</manifest>")
    return document(head, section(0, files, key, line), foot)


def gmns_nodes(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """``node.csv``: whole-number ids, a zone only where demand begins or ends. Two ids of one number raise."""
    at = nodes.join(zones.select(_c("node"), F.lit(1).alias("zone")), "node", "left").withColumn("node_id", identity.int_index(_c("node")))
    twice = at.groupBy("node_id").agg(F.count("*").alias("k"))
    checked = at.join(twice, "node_id").withColumn("node_id", F.when(F.col("k") == 1, F.col("node_id")).otherwise(F.raise_error(F.concat(F.lit("two nodes have the number "), "node_id")).cast("bigint")))
    zone = F.coalesce("zone", F.lit(0))
    return checked.select(
        F.lit("").alias("name"), "node_id", F.when(zone == 1, _c("node_id")).alias("zone_id"), fixed(_c("x"), 6).alias("x_coord"), fixed(_c("y"), 6).alias("y_coord"),
        zone.alias("production"), zone.alias("attraction"),
    )


def gmns_links(links: DataFrame) -> DataFrame:
    """``link.csv``: kilometres, km/h and the volume-delay parameters; self-loops and links under a metre are left out."""
    km, kmh = F.greatest(_c("length") / 1000, F.lit(0.001)), F.greatest(_c("speed") * 3.6, F.lit(5.0))
    lanes = F.greatest(_c("lanes"), F.lit(1))
    return links.where("from_node <> to_node AND length >= 1").select(
        identity.int_index(_c("link_id")).alias("link_id"), identity.int_index(_c("from_node")).alias("from_node_id"), identity.int_index(_c("to_node")).alias("to_node_id"),
        fixed(km, 5).alias("length"), lanes.alias("lanes"), (lanes * 1800).alias("capacity"), fixed(kmh, 1).alias("free_speed"), F.lit(1).alias("link_type"),
        fixed(km / kmh * 60, 5).alias("VDF_fftt1"), (lanes * 1800).alias("VDF_cap1"), F.lit("0.15").alias("VDF_alpha1"), F.lit(4).alias("VDF_beta1"),
    )


#: Movement types of turn restrictions.
MOVEMENTS = {
    "no_left_turn": "left",
    "no_right_turn": "right",
    "no_u_turn": "u_turn",
    "no_straight_on": "thru",
    "only_left_turn": "left",
    "only_right_turn": "right",
    "only_straight_on": "thru",
}


def gmns_movements(numbered: DataFrame) -> DataFrame:
    """``movement.csv`` of restrictions that carry their place ``k`` by (via, from, to)."""
    kind = F
    for rule, name in MOVEMENTS.items():
        kind = kind.when(_c("type") == rule, name)
    return numbered.select(
        F.concat(F.lit("m"), "k").alias("mvmt_id"), _c("via_node").alias("node_id"), _c("from_link").alias("ib_link_id"), _c("to_link").alias("ob_link_id"),
        kind.otherwise("other").alias("type"), F.lit(99999).alias("penalty"), F.lit(0).alias("capacity"), F.lit("no_control").alias("ctrl_type"), _c("type").alias("osm_restriction"),
    )


def gmns_demand(trips: DataFrame) -> DataFrame:
    """``demand.csv``: trips by origin and other destination, as numbers."""
    ends = trips.where("origin <> destination").select(identity.int_index(_c("origin")).alias("o_zone_id"), identity.int_index(_c("destination")).alias("d_zone_id"))
    return ends.groupBy("o_zone_id", "d_zone_id").agg(F.count("*").alias("volume"))


def gmns_settings(periods: DataFrame, iterations: int) -> DataFrame:
    """Settings with the demand periods (``period_id, period, first, last``: hours as ``HHMM``)."""
    head = text(periods.sparkSession, 0, "[assignment]", "assignment_mode,number_of_iterations,column_updating_iterations", f"ue,{iterations},{iterations}", "[demand_period]", "demand_period_id,demand_period,time_period")
    line = F.concat_ws(",", "period_id", "period", F.concat_ws("_", "first", "last"))
    return document(head, section(1, periods, _c("period_id"), line))


def gmns_settings_yml(agents: DataFrame, periods: DataFrame, iterations: int) -> DataFrame:
    """The same for newer engines, with the kinds of agents (``agent``)."""
    spark, say = periods.sparkSession, lambda a, x: F.concat(F.lit(a), x)
    kinds = block(1, agents, _c("agent"), say("  - type: ", F.substring("agent", 1, 1)), say("    name: ", _c("agent")), "    vot: 10")
    times = block(3, periods, _c("period_id"), say("  - period: ", _c("period")), say("    time_period: ", F.concat_ws("-", "first", "last")))
    return document(text(spark, 0, "---", "agents:"), kinds, text(spark, 2, "demand_periods:"), times, text(spark, 4, "assignment:", f"  iterations: {iterations}"))


def latex_table(cells: DataFrame) -> DataFrame:
    """A table of the cells with a success (``line, breaks`` of a report's order): a rule where the scenario changes."""
    spark = cells.sparkSession
    r = F.when(F.isnan("r"), "n/a").otherwise(fixed(_c("r"), 4))
    row = F.concat(F.replace(_c("scenario"), F.lit("_"), F.lit("\\_")), F.lit(" & "), "engine", F.lit("/"), "mode", F.lit(" & "), fixed(_c("mean_runtime"), 2), F.lit(" $\\pm$ "), fixed(_c("ci_runtime"), 3), F.lit(" & "), "trips", F.lit(" & "), r, F.lit(" \\\\"))
    key = _place(_c("line"))
    head = ("\\begin{tabular}{llrrr}", "\\toprule", "Scenario & Engine & Runtime (s) & Trips & R-Score \\\\", "\\midrule")
    return document(text(spark, 0, *head), section(1, cells.where("breaks"), key, F.lit("\\midrule"), 0), section(1, cells, key, row, 1), text(spark, 2, "\\bottomrule", "\\end{tabular}"))


def markdown_table(cells: DataFrame) -> DataFrame:
    """A table of all cells by scenario, engine and mode; failed ones have no figures."""
    spark = cells.sparkSession
    good = F.concat(
        F.lit("| "), "scenario", F.lit(" | "), "engine", F.lit(" | "), "mode", F.lit(" | "), fixed(_c("mean_runtime"), 2), F.lit(" ± "), fixed(_c("ci_runtime"), 3), F.lit(" | "),
        F.floor("mean_trips").cast("string"), F.lit(" | "), fixed(_c("mean_tt"), 1), F.lit(" ± "), fixed(_c("ci_tt"), 2), F.lit(" | "), F.when(F.isnan("r"), "nan").otherwise(fixed(_c("r"), 4)), F.lit(" |"),
    )
    failed = F.concat(F.lit("| "), "scenario", F.lit(" | "), "engine", F.lit(" | "), "mode", F.lit(" | FAILED | - | - | - |"))
    key = F.concat_ws("\t", "scenario", "engine", "mode")
    head = ("| Scenario | Engine | Mode | Runtime (s) | Trips | Avg TT (s) | R-Score |", "|----------|--------|------|-------------|-------|------------|---------|")
    return document(text(spark, 0, *head), section(1, cells, key, F.when(_c("successes") > 0, good).otherwise(failed)))


#: Names of reproducibility, by the least index.
LEVELS = ((0.99, "EXCELLENT"), (0.95, "GOOD"), (0.80, "ACCEPTABLE"))


def level(r: Column) -> Column:
    """The name of an index; a dash without one."""
    name = F.when(r.isNull() | F.isnan(r), "—")
    for least, word in LEVELS:
        name = name.when(r >= least, word)
    return name.otherwise("POOR")


def scorecard_md(name: str, hashes: DataFrame, fairness: DataFrame, cells: DataFrame, failed: DataFrame) -> DataFrame:
    """A run's scorecard: the verdict, the bundles' hashes (``scenario, name, sha256``), Q1 by scenario (``scenario, verdict, engines``), reproducibility of cells (as ``cell_stats``), and the failed runs (``scenario, engine, mode, seed, error``)."""
    spark = cells.sparkSession
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    number = lambda x, places: F.when(x.isNull() | F.isnan(x), "—").otherwise(fixed(x, places))
    good = cells.where("successes > 0")
    counted = (F.col("n_tt") >= 2) & ~F.isnan("r")
    index = good.agg(F.avg(F.when(counted, F.col("r"))).alias("r"), F.coalesce(F.bool_or(counted & (F.col("r") < 0.8)), F.lit(False)).alias("low"))
    runs = cells.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.coalesce(F.sum("successes"), F.lit(0)).alias("successes"))
    drift = fairness.agg(F.coalesce(F.bool_or(F.col("verdict") == "FAIL"), F.lit(False)).alias("drift"))
    whole = index.crossJoin(runs).crossJoin(drift)  # one row each
    lost = F.col("runs") - F.col("successes")
    verdict = (
        F.when(F.col("drift"), "FAIL — feasibility verdict drift across engines").when(F.col("low"), "WARN — at least one cell has R < 0.80")
        .when(lost > 0, say("WARN — ", lost.cast("string"), "/", F.col("runs").cast("string"), " cell(s) failed")).otherwise("PASS")
    )
    one = F.lit("")
    key = F.concat_ws("\t", "scenario", "engine", "mode")
    bundle = hashes.select("scenario").distinct()
    row = say("| `", F.col("scenario"), "` | `", F.col("engine"), "` | `", F.col("mode"), "` | ", F.col("n_tt").cast("string"), " | ", number(F.col("mean_tt"), 2), " | ", number(F.col("std_tt"), 2), " | ", number(F.col("r"), 4), " | ", level(F.col("r")), " |")
    error = F.substring(F.split(F.coalesce("error", F.lit("")), "\n")[0], 1, 72)
    return document(
        text(spark, 0, f"# Reproducibility Scorecard — `{name}`", ""), block(1, whole, one, say("**Overall verdict: `", verdict, "`**"), ""),
        text(spark, 2, "## Provenance", ""), section(3, bundle, F.col("scenario"), say("- `", F.col("scenario"), "`"), 0),
        section(3, hashes, F.concat_ws("\t", "scenario", "name"), say("  - `", F.col("name"), "` — `", F.substring("sha256", 1, 32), "…`"), 1),
        text(spark, 4, "", "## Cross-engine fairness", "", "| Scenario | Q1 verdict | Engines reporting |", "|---|---|---|"),
        section(5, fairness, F.col("scenario"), say("| `", F.col("scenario"), "` | `", F.col("verdict"), "` | ", F.col("engines"), " |")),
        text(spark, 6, "", "## Reproducibility", "", "| Scenario | Engine | Mode | N reps | mean TT (s) | σ (s) | R | Verdict |", "|---|---|---|---:|---:|---:|---:|---|"), section(7, good, key, row),
        block(8, whole.where("r IS NOT NULL"), one, "", say("**Overall R (mean across cells with N≥2):** `", fixed(F.col("r"), 4), "` (", level(F.col("r")), ")")),
        block(9, whole, one, "", "## Run summary", "", say("- **Total runs:** ", F.col("runs").cast("string")), say("- **Successful:** ", F.col("successes").cast("string")), say("- **Failed:** ", lost.cast("string"))),
        block(10, whole.where(lost > 0), one, "", "### Failed runs", "", "| Scenario | Engine | Mode | Seed | Error |", "|---|---|---|---:|---|"),
        section(11, failed, F.concat_ws("\t", key, F.lpad(F.col("seed").cast("string"), 9, "0")), say("| `", F.col("scenario"), "` | `", F.col("engine"), "` | `", F.col("mode"), "` | ", F.col("seed").cast("string"), " | ", error, " |")),
    )
