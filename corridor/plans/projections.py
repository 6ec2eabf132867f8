"""Queries on scalar projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.functions import clock, geo, identity, labels, numbers, roads
from corridor.operators import fidelity, statistics
from corridor.plans.derived import frame, sql
from corridor.registry import query

_HMS = (
    "CASE WHEN len(string_split(hms, ':')) = 3 THEN coalesce(TRY_CAST(string_split(hms, ':')[1] AS BIGINT) * 3600 + TRY_CAST(string_split(hms, ':')[2] AS BIGINT) * 60 "
    "+ TRY_CAST(string_split(hms, ':')[3] AS DOUBLE), 0) ELSE 0 END"
)


def _project(name: str, source: str, key: str, column, select: str):
    """A query of one computed column ``value`` beside its row's key."""

    def run(spark, sf_dir):
        return frame(spark, sf_dir, source).select(key, column().alias("value"))

    query(name, sql(source, f"SELECT {key}, {select} AS value FROM f"))(run)


_c = F.col
_project("prj_hms", "clock", "event_id", lambda: clock.hms_seconds(_c("hms")), f"CAST({_HMS} AS DOUBLE)")
_project("prj_hms_viz", "clock", "event_id", lambda: clock.hms_seconds(F.coalesce("hms", F.lit(""))), f"CAST({_HMS} AS DOUBLE)")
_project(
    "prj_to_hms", "clock", "event_id", lambda: clock.to_hms(_c("s")),
    "printf('%02d:%02d:%02d', greatest(s, 0) // 3600, greatest(s, 0) % 3600 // 60, greatest(s, 0) % 60)",
)
_project("prj_hhmm", "clock", "event_id", lambda: clock.to_hhmm(F.abs("s")), "printf('%02d:%02d', abs(s) // 3600, abs(s) % 3600 // 60)")
_project("prj_departure", "tags", "id", lambda: clock.departure(_c("minutes"), 21_600, 28_000), "CAST(greatest(21600, least(27999, 28800 - minutes * 60)) AS INTEGER)")

_SPEEDS = (
    "CASE road WHEN 'motorway' THEN 33.3 WHEN 'residential' THEN 11.1 WHEN 'tertiary' THEN 13.9 WHEN 'service' THEN 8.3 WHEN 'primary_link' THEN 16.7 WHEN 'secondary' THEN 16.7 ELSE 13.9 END::DOUBLE"
)
_READ = "TRY_CAST(trim(replace(replace(lower(maxspeed), 'mph', ''), 'km/h', '')) AS DOUBLE)"
_project(
    "prj_speed_parse", "tags", "id", lambda: roads.speed_mps(_c("maxspeed"), _c("road")),
    f"round_even(coalesce(CASE WHEN lower(maxspeed) LIKE '%mph%' THEN {_READ} * 0.44704::DOUBLE ELSE {_READ} / 3.6::DOUBLE END, {_SPEEDS}), 1)",
)
_project(
    "prj_lanes_parse", "tags", "id", lambda: roads.lanes(_c("lanes"), _c("road")),
    "coalesce(CASE WHEN regexp_full_match(trim(lanes), '[+-]?[0-9]+') THEN CAST(trim(lanes) AS INTEGER) END, CASE road WHEN 'motorway' THEN 3 WHEN 'secondary' THEN 2 ELSE 1 END)",
)
_project("prj_pick_first", "tags", "id", lambda: roads.pick_first(F.split("roads", ",")), "list_sort(string_split(roads, ','))[1]")
_project(
    "prj_pick_highway", "tags", "id", lambda: roads.pick_class(F.split("roads", ",")),
    "list_sort(list_transform(string_split(roads, ','), lambda t: CASE t WHEN 'motorway' THEN 10 WHEN 'primary_link' THEN 15 WHEN 'secondary' THEN 16 WHEN 'tertiary' THEN 18 "
    "WHEN 'residential' THEN 20 WHEN 'service' THEN 23 ELSE 24 END || t))[1][3:]",
)
_project("prj_mode_of_person", "tags", "id", lambda: roads.mode_of(_c("code")), "CASE WHEN code BETWEEN 2 AND 6 THEN 'transit' WHEN code = 9 THEN 'bike' WHEN code = 10 THEN 'walk' WHEN code IN (11, 12) THEN 'home' ELSE 'car' END")
_project("prj_is_school", "tags", "id", lambda: roads.is_school(_c("kind")), "coalesce(string_split(trim(lower(kind)), ':')[1] IN ('school', 'kindergarten', 'preschool', 'college', 'university'), false)")
_project("prj_style", "tags", "id", lambda: roads.line_width(_c("road")), "CASE road WHEN 'motorway' THEN 1.0 WHEN 'primary_link' THEN 0.7 WHEN 'secondary' THEN 0.7 WHEN 'service' THEN 0.25 WHEN 'track' THEN 0.25 WHEN 'footway' THEN 0.15 ELSE 0.4 END::DOUBLE")
_project(
    "src_osm_way_list", "tags", "id", lambda: F.array_join(roads.way_ids(_c("ways")).cast("array<string>"), " "),
    "array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(ways, ''), '[\\[\\]]', '', 'g'), ','), lambda p: TRY_CAST(trim(p) AS BIGINT)), lambda x: x IS NOT NULL), ' ')",
)
_project("prj_color_index", "tags", "id", lambda: geo.colour_index(_c("price") - 900), "CASE WHEN price - 900 < 10 THEN 32 ELSE CAST(trunc(least(132, 32 + log10((price - 900) / 10) * 30)) AS INTEGER) END")
_project("prj_int_index", "tags", "id", lambda: identity.int_index(F.concat(F.lit("n"), "id")), "id")

_project("prj_num", "named_runs", "id", lambda: identity.number(_c("loose")), "CASE loose WHEN '12.5' THEN 12.5 WHEN '7' THEN 7 ELSE 0 END::DOUBLE")
_project("prj_scenario_size", "named_runs", "id", lambda: identity.size_tier(F.coalesce("scenario_id", F.lit(""))), "CASE WHEN regexp_matches(scenario_id, '(^|_)[0-9]+k(_|$)') THEN CAST(regexp_extract(scenario_id, '(?:^|_)([0-9]+)k(?:_|$)', 1) AS INTEGER) ELSE 0 END")
_project("prj_short_mode", "named_runs", "id", lambda: identity.short_mode(_c("mode")), "CASE mode WHEN 'microscopic' THEN 'micro' WHEN 'mesoscopic' THEN 'meso' ELSE mode END")
_project(
    "prj_scenario_id", "named_runs", "id", lambda: identity.scenario_name(F.lit("city"), _c("trips"), F.array(F.lit("walk"), F.lit("car"))),
    "'city_' || CASE WHEN trips >= 1000000 THEN (trips // 1000000) || 'm' WHEN trips >= 1000 THEN (trips // 1000) || 'k' ELSE CAST(trips AS VARCHAR) END || '_car_walk'",
)
_project(
    "src_scenarios_auto", "named_runs", "id", lambda: F.coalesce(identity.name_tier(_c("scenario_id")), F.lit(0)),
    "coalesce(CAST(nullif(regexp_extract(scenario_id, '([0-9]+)k(_|$)', 1), '') AS BIGINT) * 1000, 0)",
)

_HAS = "(scenario_id LIKE '%\\_{e}' ESCAPE '\\' OR scenario_id LIKE '%\\_{e}\\_%' ESCAPE '\\')"
_ENGINE = "CASE " + " ".join(f"WHEN {_HAS.format(e=e)} THEN '{e}'" for e in ("sumo", "matsim", "dtalite")) + " END"


@query(
    "prj_identity",
    sql(
        "named_runs",
        f", e AS (SELECT *, {_ENGINE} AS p FROM f) SELECT id, coalesce(nullif(scenario, ''), CASE WHEN p IS NULL THEN coalesce(nullif(scenario_id, ''), 'unknown') "
        "ELSE replace(replace(replace(scenario_id, '_' || p || '_meso', ''), '_' || p || '_micro', ''), '_' || p, '') END) AS scenario, coalesce(nullif(engine, ''), p, 'unknown') AS engine, "
        "coalesce(nullif(mode, ''), CASE WHEN contains(scenario_id, '_' || p || '_meso') THEN 'meso' WHEN contains(scenario_id, '_' || p || '_micro') THEN 'micro' END, 'unknown') AS mode FROM e",
    ).replace(") , e AS", "), e AS"),
)
def prj_identity(spark, sf_dir):
    found = identity.resolve(*map(F.col, ("scenario", "engine", "mode", "scenario_id")))
    return frame(spark, sf_dir, "named_runs").select("id", *(c.alias(k) for k, c in found.items()))


_PARTS = (
    ", e AS (SELECT *, string_split(coalesce(scenario_id, ''), '_') AS p FROM f), g AS (SELECT *, CASE WHEN list_contains(p, 'sumo') THEN 'sumo' WHEN list_contains(p, 'matsim') THEN 'matsim' "
    "WHEN list_contains(p, 'dtalite') THEN 'dtalite' ELSE 'unknown' END AS pe, CASE WHEN list_has_any(p, ['micro', 'microscopic']) THEN 'micro' ELSE 'meso' END AS pm, "
    "array_to_string(list_filter(p, lambda x: x NOT IN ('sumo', 'matsim', 'dtalite', 'meso', 'micro', 'mesoscopic', 'microscopic')), '_') AS pc FROM e) "
)


@query("prj_identity_parse", sql("named_runs", _PARTS + "SELECT id, pc AS city, pe AS engine, pm AS mode FROM g").replace(") , e AS", "), e AS"))
def prj_identity_parse(spark, sf_dir):
    found = identity.from_segments(F.coalesce("scenario_id", F.lit("")))
    return frame(spark, sf_dir, "named_runs").select("id", *(c.alias(k) for k, c in found.items()))


@query(
    "prj_identity_plots",
    sql(
        "named_runs",
        _PARTS + ", h AS (SELECT id, coalesce(nullif(scenario, ''), pc) AS city, coalesce(nullif(engine, ''), pe) AS engine, coalesce(nullif(mode, ''), pm) AS m FROM g) "
        "SELECT id, city, engine, CASE WHEN m IN ('micro', 'meso') THEN m WHEN contains(m, 'micro') THEN 'micro' ELSE 'meso' END AS mode FROM h",
    ).replace(") , e AS", "), e AS").replace(") , h AS", "), h AS"),
)
def prj_identity_plots(spark, sf_dir):
    rows = frame(spark, sf_dir, "named_runs").withColumn("scenario_id", F.coalesce("scenario_id", F.lit("")))
    found = identity.resolve_segments(*map(F.col, ("scenario", "engine", "mode", "scenario_id")))
    return rows.select("id", *(c.alias(k) for k, c in found.items()))


_T = (
    "CASE WHEN n <= 1 THEN 0 WHEN n > 31 THEN 1.96 ELSE [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, "
    "2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042][n - 1] END::DOUBLE"
)
_HALF = f"CASE WHEN n < 2 THEN 0 ELSE {_T} * y / sqrt(n) END"
_project("prj_t_crit", "readings", "id", lambda: statistics.t_critical(_c("n")), _T)
_project("prj_geh", "readings", "id", lambda: numbers.rounded(fidelity.geh(F.col("geh"), F.col("y")), 6), "CASE WHEN geh <= 0 OR y <= 0 THEN 'Infinity'::DOUBLE ELSE round(sqrt(2 * (y - geh) * (y - geh) / (y + geh)), 6) END")
_project("prj_interpret_geh", "readings", "id", lambda: labels.geh_reading(_c("geh")), "CASE WHEN geh < 5 THEN 'acceptable' WHEN geh < 10 THEN 'warrants investigation' ELSE 'poor fit' END")
_project("prj_ci_low", "readings", "id", lambda: F.col("x") - statistics.half_width(_c("n"), _c("y")), f"x - {_HALF}")
_project("prj_ci_high", "readings", "id", lambda: F.col("x") + statistics.half_width(_c("n"), _c("y")), f"x + {_HALF}")
_project(
    "prj_interpret_ks", "readings", "id", lambda: labels.ks_reading(_c("d"), _c("critical")),
    "CASE WHEN critical IS NULL THEN 'no test performed' WHEN d < critical THEN printf('distributions similar (D=%.4f < critical=%.4f)', d, critical) ELSE printf('distributions differ (D=%.4f >= critical=%.4f)', d, critical) END",
)
_project("prj_interpret_r", "readings", "id", lambda: labels.scorecard_grade(_c("r")), "CASE WHEN r IS NULL THEN 'N/A' WHEN r >= 0.99 THEN 'EXCELLENT' WHEN r >= 0.95 THEN 'GOOD' WHEN r >= 0.8 THEN 'ACCEPTABLE' ELSE 'POOR' END")
_project("prj_q3_mark", "readings", "id", lambda: F.when(F.col("n") == F.floor("geh"), "PASS").otherwise("WARN"), "CASE WHEN n = floor(geh) THEN 'PASS' ELSE 'WARN' END")


@query(
    "prj_bbox_center",
    sql("boxes", "SELECT id, round(lat + radius / 111, 8) AS north, round(lat - radius / 111, 8) AS south, round(lon + radius / (111 * cos(radians(lat))), 8) AS east, round(lon - radius / (111 * cos(radians(lat))), 8) AS west FROM f"),
)
def prj_bbox_center(spark, sf_dir):
    found = geo.box_around(*map(F.col, ("lat", "lon", "radius")))
    return frame(spark, sf_dir, "boxes").select("id", *(numbers.rounded(c, 8).alias(k) for k, c in found.items()))


@query("src_bbox_string", sql("boxes", "SELECT id, lat + 1 AS north, lat AS south, lon + 1 AS east, lon AS west FROM f"))
def src_bbox_string(spark, sf_dir):
    rows = frame(spark, sf_dir, "boxes").select("id", F.expr("concat_ws(', ', lat + 1, lat, lon + 1, lon)").alias("text"))
    part = F.split("text", ",")
    wrong = F.raise_error(F.concat(F.lit("expected four values: "), "text"))
    rows = rows.withColumn("part", F.when(F.size(part) == 4, part).otherwise(wrong.cast("array<string>")))
    return rows.select("id", *(F.trim(F.col("part")[i]).cast("double").alias(k) for i, k in enumerate(("north", "south", "east", "west"))))


@query("prj_speed_ratio", sql("link_speeds", "SELECT engine, link_id, volume, CASE WHEN free_kmh <= 0 THEN 1 ELSE least(1, mean_kmh / free_kmh) END AS value FROM f"))
def prj_speed_ratio(spark, sf_dir):
    return frame(spark, sf_dir, "link_speeds").select("engine", "link_id", "volume", geo.speed_ratio(F.col("mean_kmh"), F.col("free_kmh")).alias("value"))


@query("prj_link_key", sql("link_speeds", "SELECT DISTINCT engine, CASE WHEN regexp_full_match(link_id, '[0-9]+') THEN 'l' || link_id ELSE link_id END AS link FROM f WHERE volume > 0"))
def prj_link_key(spark, sf_dir):
    return frame(spark, sf_dir, "link_speeds").where("volume > 0").select("engine", identity.link_key(F.col("link_id")).alias("link")).distinct()


@query("prj_line_width", sql("link_speeds", ", g AS (SELECT link_id, sum(volume) AS v FROM f GROUP BY 1), m AS (SELECT min(v) AS a, max(v) AS b FROM g WHERE v > 0) SELECT link_id, round(CASE WHEN a = b THEN 1.75 ELSE 0.5 + 2.5 * sqrt((v - a) / (b - a)) END, 6) AS value FROM g, m WHERE v > 0").replace(") , g AS", "), g AS"))
def prj_line_width(spark, sf_dir):
    by = frame(spark, sf_dir, "link_speeds").groupBy("link_id").agg(F.sum("volume").alias("v")).where("v > 0")
    ends = by.agg(F.min("v").alias("a"), F.max("v").alias("b"))  # one row
    return by.crossJoin(F.broadcast(ends)).select("link_id", numbers.rounded(geo.scaled_width(F.col("v"), F.col("a"), F.col("b"), 0.5, 3.0), 6).alias("value"))


@query(
    "prj_error_oneline",
    sql(
        "errors",
        ", a AS (SELECT id, trim(coalesce(error, '')) AS t FROM f), b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^(Conversion failed: )+', ''), '^(netconvert failed: )+', ''), '^(Error: )+', ''), '^(Warning: )+', '') AS t FROM a), "
        "l AS (SELECT id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM b), "
        "h AS (SELECT id, len(l) AS k, regexp_replace(regexp_replace(l[1], '^Warning: ', ''), '^Error: ', '') AS head, CASE WHEN len(l) > 1 THEN ' (+' || (len(l) - 1) || ' more)' ELSE '' END AS tail FROM l) "
        "SELECT id, CASE WHEN k = 0 THEN 'unknown error' WHEN length(head) <= 80 - length(tail) THEN head || tail ELSE CASE WHEN contains(head[:80 - length(tail)], ' ') "
        "THEN regexp_replace(head[:80 - length(tail)], ' [^ ]*$', '') ELSE head[:80 - length(tail)] END || '…' || tail END AS value FROM h",
    ).replace(") , a AS", "), a AS"),
)
def prj_error_oneline(spark, sf_dir):
    return frame(spark, sf_dir, "errors").select("id", identity.one_line_error(F.col("error")).alias("value"))
