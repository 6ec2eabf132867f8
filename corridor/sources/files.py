"""Readers: networks, manifests and events from XML, demand and engine outputs from CSV, results from JSON, models and logs from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.functions import clock, identity, roads
from corridor.operators.ranges import numbered

_c = F.col


def xml(spark: SparkSession, path: str, tag: str, schema: T.StructType | str) -> DataFrame:
    """All elements ``tag``. Files may be parts of a document: each is searched for the tag, wherever its root is."""
    return spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).schema(schema).load(path)


def xml_rows(spark: SparkSession, path: str, tag: str, attributes: list[str]) -> DataFrame:
    """Attributes of all elements ``tag`` as text, with ``pos``: their place in the files, in order of names and bytes."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attributes])
    rows = xml(spark, path, tag, schema)
    where = rows.select(
        *(F.col(f"_{a}").alias(a) for a in attributes), F.concat_ws(":", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return numbered(where, ["_row"], F.col("_block"), "pos").drop("_block", "_row")


def _number(x: Column, kind: str, default) -> Column:
    return F.coalesce(F.trim(x).try_cast(kind), F.lit(default))


def filled(*names: str) -> Column:
    """All of the named columns hold text."""
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(F.col(n), F.lit("")) != "")
    return out


LINK = ["id", "from", "to", "length", "lanes", "speed_limit", "highway_type", "osm_way_id", "name"]


def network_links(spark: SparkSession, path: str) -> DataFrame:
    """Links with an id and both ends, as text."""
    return xml_rows(spark, path, "link", LINK).where(filled("id", "from", "to")).withColumnsRenamed({"id": "link_id", "from": "from_node", "to": "to_node", "pos": "link_pos"})


def network_nodes(spark: SparkSession, path: str) -> DataFrame:
    return xml_rows(spark, path, "node", ["id", "x", "y", "type", "osm_id", "has_signal"]).where(filled("id")).withColumnRenamed("id", "node")


def scc_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges for components: no self-loops."""
    return network_links(spark, path).where("from_node <> to_node").select("from_node", "to_node")


def routing_links(spark: SparkSession, path: str) -> DataFrame:
    """Links for routing, self-loops too, with their place."""
    return network_links(spark, path).select("link_id", "link_pos", "from_node", "to_node")


def sumo_links(spark: SparkSession, path: str) -> DataFrame:
    """Typed links: what can't be read is 0 m, 13.9 m/s and one lane; lengths and speeds are 0.1 or more, lanes 1."""
    return network_links(spark, path).select(
        "link_id", "from_node", "to_node", F.greatest(_number(_c("length"), "double", 0.0), F.lit(0.1)).alias("length"),
        F.greatest(_number(_c("speed_limit"), "double", 13.9), F.lit(0.1)).alias("speed"), F.greatest(_number(_c("lanes"), "int", 1), F.lit(1)).alias("lanes"),
    )


def matsim_links(spark: SparkSession, path: str) -> DataFrame:
    """Typed links: 100 m, 13.9 m/s and one lane where absent; a bad number raises."""
    strict = lambda c, kind, d: F.coalesce(F.col(c).cast(kind), F.lit(d))
    return network_links(spark, path).select("link_id", "from_node", "to_node", strict("length", "double", 100.0).alias("length"), strict("speed_limit", "double", 13.9).alias("speed"), strict("lanes", "int", 1).alias("lanes"))


def topology(spark: SparkSession, path: str) -> DataFrame:
    """Nodes with their in- and outgoing links in order and whether they have a signal."""
    links = network_links(spark, path)
    listed = lambda end, name: links.groupBy(F.col(end).alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("link_pos", "link_id"))), lambda x: x["link_id"]).alias(name))
    nodes = network_nodes(spark, path).select("node", (F.coalesce("has_signal", F.lit("")) == "true").alias("has_signal"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return nodes.join(listed("to_node", "into"), "node", "left").join(listed("from_node", "out"), "node", "left").select("node", "has_signal", empty("into"), empty("out"))


def nodes_with_degree(spark: SparkSession, path: str) -> DataFrame:
    """Nodes with coordinates and degree; 0 where no link touches them."""
    links = scc_edges(spark, path)
    ends = links.select(F.col("from_node").alias("node")).union(links.select(F.col("to_node").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return network_nodes(spark, path).join(degree, "node", "left").select("node", _number(_c("x"), "double", 0.0).alias("x"), _number(_c("y"), "double", 0.0).alias("y"), F.coalesce("degree", F.lit(0)).alias("degree"))


def drawn_links(spark: SparkSession, path: str) -> DataFrame:
    """Links with their class and way ids, for maps."""
    return network_links(spark, path).select("link_id", "from_node", "to_node", _c("highway_type").alias("road"), roads.way_ids(_c("osm_way_id")).alias("ways"))


def turn_restrictions(spark: SparkSession, path: str) -> DataFrame:
    names = ["type", "from_link", "via_node", "to_link"]
    return xml_rows(spark, path, "turn_restriction", names).where(filled(*names)).select(*names)


def manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """``type, path, sha256`` of a bundle's files. A required type that is absent raises."""
    rows = xml_rows(spark, path, "file", ["type", "path", "sha256"]).where(filled("type", "path")).select("type", "path", "sha256")
    if required:
        found = {r["type"] for r in rows.select("type").distinct().collect()}  # a handful of types
        if lacking := sorted(set(required) - found):
            raise KeyError(f"the manifest names no {', '.join(lacking)}")
    return rows


def csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Named columns of a CSV with a header (plain or gzip), as text; absent ones are null."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    return rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def missing_columns(headers: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """``key, missing``: the wanted columns that a file's header (``value``) lacks."""
    lacking = F.array_except(F.array(*map(F.lit, wanted)), F.transform(F.split("value", ","), F.trim))
    return headers.select(key, F.explode(lacking).alias("missing"))


def demand(spark: SparkSession, path: str) -> DataFrame:
    """Trips with both ends; the purpose may lack."""
    rows = csv(spark, path, ["trip_id", "origin_node_id", "destination_node_id", "departure_time_s", "mode", "dest_source", "purpose"])
    return rows.where(filled("origin_node_id", "destination_node_id"))


def tripinfo(spark: SparkSession, path: str) -> DataFrame:
    """``trip_id, duration`` of a SUMO trip report; without the prefix of vehicles, unreadable durations dropped."""
    rows = xml_rows(spark, path, "tripinfo", ["id", "depart", "duration", "routeLength"])
    number = lambda c: F.col(c).try_cast("double")
    return rows.select("pos", F.regexp_replace("id", "^veh_", "").alias("trip_id"), number("depart").alias("depart"), number("duration").alias("duration"), number("routeLength").alias("length")).where("duration IS NOT NULL")


def last_by_trip(trips: DataFrame, value: str) -> DataFrame:
    """The last value of each trip."""
    return trips.groupBy("trip_id").agg(F.max_by(value, "pos").alias(value))


def sumo_routes(spark: SparkSession, path: str) -> DataFrame:
    """``trip_id, links`` of a SUMO route file."""
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("route", T.StructType([T.StructField("_edges", T.StringType())]))])
    rows = xml(spark, path, "vehicle", schema)
    return rows.select(F.regexp_replace("_id", "^veh_", "").alias("trip_id"), F.filter(F.split(F.coalesce("route._edges", F.lit("")), r"\s+"), lambda x: x != "").alias("links"))


def matsim_trips(spark: SparkSession, path: str) -> DataFrame:
    """``trip_id, seconds`` of a MATSim trip table, by person."""
    rows = csv(spark, path, ["person", "trav_time", "dep_time", "traveled_distance"], ";")
    return rows.select(F.regexp_replace("person", "^person_", "").alias("trip_id"), clock.hms_seconds(_c("trav_time")).alias("seconds"), clock.hms_seconds(_c("dep_time")).alias("depart"), _number(_c("traveled_distance"), "double", 0.0).alias("distance"))


def dtalite_agents(spark: SparkSession, path: str) -> DataFrame:
    """``tt`` in seconds, ``distance`` in metres and ``volume`` of each path; rows with a bad number are dropped, absent ones are 0, and 1 for the volume."""
    rows = csv(spark, path, ["o_zone_id", "d_zone_id", "volume", "travel_time", "distance"])
    read = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(d)).otherwise(F.col(c).try_cast("double"))
    out = rows.select("o_zone_id", "d_zone_id", (read("travel_time", 0.0) * 60).alias("tt"), (read("distance", 0.0) * 1000).alias("distance"), read("volume", 1.0).alias("volume"))
    return out.where("tt IS NOT NULL AND distance IS NOT NULL AND volume IS NOT NULL")


def dtalite_trips(spark: SparkSession, path: str) -> DataFrame:
    """One row a path, its ends as node ids."""
    return dtalite_agents(spark, path).select(F.concat(F.lit("n"), F.col("o_zone_id").cast("int")).alias("origin"), F.concat(F.lit("n"), F.col("d_zone_id").cast("int")).alias("destination"), "tt", "distance")


def dtalite_links(spark: SparkSession, path: str) -> DataFrame:
    """Volumes and speeds of links; names of columns differ by version, and a free speed that lacks is the mean one."""
    names = ["link_id", "from_node_id_to_node_id", "volume", "speed_kmph", "speed", "speed_kmh", "FFTT", "travel_time", "free_speed_kmph", "free_speed", "speed_limit"]
    rows = csv(spark, path, names)
    first = lambda *cs: F.coalesce(*(identity.given(F.col(c)) for c in cs))
    number = lambda *cs: F.coalesce(first(*cs).cast("double"), F.lit(0.0))
    link = F.trim(F.coalesce(first("link_id", "from_node_id_to_node_id"), F.lit("")))
    speed, free = number("speed_kmph", "speed", "speed_kmh"), number("free_speed_kmph", "free_speed", "speed_limit")
    return rows.select(link.alias("link_id"), number("volume").alias("volume"), speed.alias("mean_kmh"), F.when(free > 0, free).otherwise(speed).alias("free_kmh"), (number("FFTT", "travel_time") * 60).alias("seconds")).where("link_id <> ''")


def matsim_events(spark: SparkSession, path: str) -> DataFrame:
    """Entering and leaving events of links; the vehicle is the person where none is named."""
    rows = xml_rows(spark, path, "event", ["type", "time", "link", "vehicle", "person"])
    kind = F.when(F.col("type") == "entered link", "entered").when(F.col("type") == "left link", "left")
    return rows.select("pos", kind.alias("type"), F.col("time").try_cast("double").alias("t"), "link", F.coalesce("vehicle", "person").alias("veh")).where("type IS NOT NULL AND t IS NOT NULL AND link IS NOT NULL")


RESULT = (
    "struct<scenario: string, scenario_id: string, engine: string, mode: string, seed: int, status: string, runtime_s: double, engine_wall_s: double, cell_wall_s: double, "
    "error_message: string, metrics: struct<travel_time: struct<mean: double, p95: double, trip_count: bigint>>>"
)


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """Runs of result files (``results``, or ``runs`` in old ones). Files that hold no JSON raise."""
    schema = f"results array<{RESULT}>, runs array<{RESULT}>"
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    found = rows.select(F.explode(F.coalesce("results", "runs")).alias("r")).select("r.*")
    who = identity.resolve(*map(F.col, ("scenario", "engine", "mode", "scenario_id")))
    tt = lambda k: F.coalesce(F.col(f"metrics.travel_time.{k}"), F.lit(0))
    return found.select(
        *(c.alias(k) for k, c in who.items()), "seed", "status", F.coalesce("runtime_s", F.lit(0.0)).alias("runtime_s"), "engine_wall_s", "cell_wall_s", "error_message",
        tt("mean").cast("double").alias("tt_mean"), tt("p95").cast("double").alias("tt_p95"), tt("trip_count").cast("bigint").alias("trip_count"),
    )


#: Fields of a building's line behind its tag, and of a person's.
BUILDING = ("id", "levels", "population", "attributes", "is_home", "kind", "sq_foot", "top_lon", "top_lat", "bot_lon", "bot_lat", "way_id", "way_lat", "way_lon", "puma", "households")
PERSON = ("id", "household", "n_info", "age", "wages", "commute_min", "code")


def _fields(line: Column) -> Column:
    """Fields between blanks; a quoted one may hold blanks."""
    return F.transform(F.regexp_extract_all(line, F.lit(r'("[^"]*"|\S+)'), 1), lambda x: F.replace(x, F.lit('"'), F.lit("")))


def _typed(part: Column, i: int, kind: str) -> Column:
    return F.get(part, F.lit(i)).try_cast(kind)


def buildings(lines: DataFrame) -> DataFrame:
    """Buildings of model lines (``line``), with their centre. Malformed ones are dropped."""
    p = F.col("p")
    rows = lines.where("startswith(line, 'bld ')").select(_fields(F.col("line")).alias("p")).where("size(p) >= 17")
    number = {"id": "bigint", "levels": "int", "population": "bigint", "sq_foot": "bigint", "top_lon": "double", "top_lat": "double", "bot_lon": "double", "bot_lat": "double", "way_id": "bigint", "households": "int"}
    out = rows.select(*(_typed(p, 1 + BUILDING.index(n), k).alias(n) for n, k in number.items()), (F.lower(p[5]) == "true").alias("is_home"), p[6].alias("kind")).dropna()
    return out.withColumns({"lat": (F.col("top_lat") + F.col("bot_lat")) / 2, "lon": (F.col("top_lon") + F.col("bot_lon")) / 2})


def households(lines: DataFrame) -> DataFrame:
    """Households of model lines with the ids of their people, as many as a line holds."""
    p = F.col("p")
    rows = lines.where("startswith(line, 'hld ')").select("pos", _fields(F.col("line")).alias("p")).where("size(p) >= 9")
    serial = F.regexp_replace(p[2], "^[^,]*,", "")
    declared = _typed(p, 8, "int")
    people = F.transform(F.slice(p, 10, F.greatest(F.least(declared, F.size(p) - 9), F.lit(0))), lambda x: x.try_cast("bigint"))
    return rows.select("pos", _typed(p, 1, "bigint").alias("building"), serial.alias("serial"), _typed(p, 7, "bigint").alias("income"), people.alias("people")).where("building IS NOT NULL AND people IS NOT NULL AND NOT exists(people, x -> x IS NULL)")


def schedule(text: Column) -> Column:
    """Activities of a schedule: bounds of weekdays, time and building. Tuples of other than four whole numbers are dropped."""
    found = F.regexp_extract_all(text, F.lit(r"(\(-?\d+\s+-?\d+\s+-?\d+\s+-?\d+\))"), 1)

    def tuple_of(x: Column) -> Column:
        n = F.split(F.trim(F.regexp_replace(x, "[()]", "")), r"\s+")
        return F.struct(*(F.get(n, F.lit(i)).cast("bigint").alias(k) for i, k in enumerate(("from_day", "to_day", "time_s", "building"))))

    return F.transform(found, tuple_of)


def persons(lines: DataFrame) -> DataFrame:
    """Persons of model lines with their schedule."""
    rows = lines.where("startswith(line, 'per ')").select("line", F.split("line", r"\s+").alias("p")).where("size(p) >= 8")
    p = F.col("p")
    kinds = {"id": "bigint", "n_info": "int", "age": "int", "wages": "bigint", "commute_min": "int", "code": "int"}
    quoted = F.regexp_extract("line", r'"(.*)"', 1)
    out = rows.select(*(_typed(p, 1 + PERSON.index(n), k).alias(n) for n, k in kinds.items()), p[2].alias("household"), schedule(quoted).alias("schedule"))
    return out.where("id IS NOT NULL AND n_info IS NOT NULL AND age IS NOT NULL AND wages IS NOT NULL AND commute_min IS NOT NULL AND code IS NOT NULL")


def model(lines: DataFrame, box: tuple[float, float, float, float], modes: list[str]) -> dict[str, DataFrame]:
    """The model within a box (south, north, west, east): buildings there, their households, and those people who commute by the modes."""
    south, north, west, east = box
    b = buildings(lines).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    h = households(lines).join(b.select(F.col("id").alias("building")), "building", "left_semi")
    ids = h.select(F.explode("people").alias("id")).distinct()
    p = persons(lines).join(ids, "id", "left_semi").where((F.col("commute_min") > 0) & roads.mode_of(F.col("code")).isin(*modes))
    return {"buildings": b, "households": h, "persons": p}


def model_scan(lines: DataFrame, by: str = "file") -> DataFrame:
    """Lines by kind, and commuters by mode (who stay home left out), of each model file."""
    kind = F.when(F.col("line").startswith("bld "), "bld").when(F.col("line").startswith("hld "), "hld").when(F.col("line").startswith("per "), "per")
    code = F.get(F.split("line", r"\s+"), F.lit(7)).try_cast("int")
    mode = F.when((kind == "per") & (code > 0), roads.mode_of(code))
    rows = lines.select(by, kind.alias("kind"), F.when(mode != "home", mode).alias("mode"))
    return rows.where("kind IS NOT NULL").groupBy(by).agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("bld", "hld", "per")), *(F.count(F.when(F.col("mode") == m, 1)).alias(m) for m in ("car", "transit", "bike", "walk"))
    )


def harness_log(lines: DataFrame) -> DataFrame:
    """Cells of a log's tape: engine, mode, seed, status and, of a success, the seconds; the last line of a cell counts."""
    tape = r"^\s*\[\s*\d+/\d+\]\s+(\w+)\s+(\w+)\s+seed=(\d+)\s+([✓✗])\s*(.*)$"
    part = lambda i: F.regexp_extract("line", tape, i)
    timing = r"(\d+(?:\.\d+)?)s\s+wall\s*\(\s*(\d+(?:\.\d+)?)s\s+engine\)"
    rows = lines.where(F.col("line").rlike(tape)).select("pos", F.lower(part(1)).alias("engine"), F.lower(part(2)).alias("mode"), part(3).cast("int").alias("seed"), (part(4) == "✓").alias("ok"), F.trim(part(5)).alias("rest"))
    seconds = lambda i: F.when(F.col("ok"), F.coalesce(F.regexp_extract("rest", timing, i).try_cast("double"), F.lit(0.0))).otherwise(0.0)
    why = F.trim(F.regexp_replace("rest", r"^FAIL\s+", ""))
    read = rows.select("pos", "engine", "mode", "seed", F.when(F.col("ok"), "success").otherwise("failed").alias("status"), seconds(1).alias("wall_s"), seconds(2).alias("engine_s"), F.when(~F.col("ok"), F.when(why == "", "unknown failure").otherwise(why)).alias("error"))
    keys = ["engine", "mode", "seed"]
    return read.groupBy(*keys).agg(F.max_by(F.struct("status", "wall_s", "engine_s", "error"), "pos").alias("r")).select(*keys, "r.*")


ENGINES = "sumo|matsim|dtalite"
#: Layouts of a run folder, the first found counts: pattern, and the groups of scenario, engine, mode and seed (0: not in the path).
LAYOUTS = (
    (rf"^(.+)_({ENGINES})_(meso|micro)_seed(\d+)/native_files$", (1, 2, 3, 4)),
    (rf"^([^/]+)/({ENGINES})/(meso|micro)/seed_(\d+)$", (1, 2, 3, 4)),
    (rf"^([^/]+)/\1/({ENGINES})/(meso|micro)/seed_(\d+)$", (1, 2, 3, 4)),
    (rf"^({ENGINES})/(meso|micro)/seed_(\d+)$", (0, 1, 2, 3)),
    (rf"^([^/]+)/({ENGINES})/seed_(\d+)$", (1, 2, 0, 3)),
    (rf"^([^/]+)/\1/({ENGINES})/seed_(\d+)$", (1, 2, 0, 3)),
    (rf"^({ENGINES})/seed_(\d+)$", (0, 1, 0, 2)),
)


def cells_of_paths(paths: DataFrame, base: str) -> DataFrame:
    """``path, layout, scenario, engine, mode, seed`` of the folders (``path`` below a run's) that are cells; what a path does not tell is the run's own name, or null."""
    pick = {k: F for k in ("layout", "scenario", "engine", "mode", "seed")}
    for i, (pattern, groups) in enumerate(LAYOUTS):
        hit = F.col("path").rlike(pattern)
        pick["layout"] = pick["layout"].when(hit, i)
        for name, g in zip(("scenario", "engine", "mode", "seed"), groups):
            absent = F.lit(base) if name == "scenario" else F.lit(None).cast("string")
            pick[name] = pick[name].when(hit, F.regexp_extract("path", pattern, g) if g else absent)
    found = paths.select("path", *(v.otherwise(F.lit(None)).alias(k) for k, v in pick.items()))
    return found.where("layout IS NOT NULL").withColumn("seed", F.col("seed").cast("int"))


def find_cells(cells: DataFrame) -> DataFrame:
    """The folder of each (scenario, engine, seed, mode): that of the first layout. Folders without a mode stand for any."""
    modes = F.explode(F.when(F.col("mode").isNull(), F.array(F.lit("meso"), F.lit("micro"))).otherwise(F.array("mode")))
    spread = cells.select("path", "layout", "scenario", "engine", "seed", modes.alias("mode"))
    return spread.groupBy("scenario", "engine", "mode", "seed").agg(F.min_by("path", F.struct("layout", "path")).alias("path"))


def recovered(expected: DataFrame, disk: DataFrame, log: DataFrame) -> DataFrame:
    """Runs rebuilt from what was planned (``scenario, engine, mode, seed, timeout_s``), what is on disk (``status, error``) and the log's seconds."""
    keys = ["engine", "mode", "seed"]
    rows = expected.join(disk.withColumnsRenamed({"status": "disk_status", "error": "disk_error"}), keys, "left").join(log.select(*keys, F.col("status").alias("log_status"), "wall_s", "engine_s"), keys, "left")
    status = F.coalesce("disk_status", F.lit("failed"))
    late = F.concat(F.upper("engine"), F.lit(" timeout after "), "timeout_s", F.lit("s"))
    error = F.when(status == "failed", F.coalesce("disk_error", F.when(F.col("engine") == "dtalite", late).otherwise(F.concat(F.lit("Cell artifact missing: "), "engine"))))
    timed = (status == "success") & (F.col("log_status") == "success")
    out_of_time = (status == "failed") & F.lower(error).contains("timeout")
    wall = F.when(timed, F.col("wall_s")).when(out_of_time, F.col("timeout_s").cast("double")).when(status == "success", F.coalesce("wall_s", F.lit(0.0))).otherwise(0.0)
    engine = F.when(timed, F.col("engine_s")).otherwise(wall)
    return rows.select("scenario", *keys, status.alias("status"), error.alias("error"), engine.alias("runtime_s"), wall.alias("cell_wall_s"))
