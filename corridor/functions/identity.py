"""Which scenario, engine and mode a run belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Engines, in order of precedence, and names of modes.
ENGINES = ("sumo", "matsim", "dtalite")
MODE_WORDS = ("meso", "micro", "mesoscopic", "microscopic")


def number(text: Column) -> Column:
    """A number from a loosely typed field; 0 for anything else."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def given(x: Column) -> Column:
    """Null where empty."""
    return F.when(x != "", x)


def from_scenario_id(scenario_id: Column) -> dict[str, Column]:
    """Scenario, engine and mode from parts of an id anywhere in it; ``unknown`` where it has none."""
    sid = F.coalesce(scenario_id, F.lit(""))
    whole = F.when(sid == "", "unknown").otherwise(sid)
    engine, mode, scenario = F, F, F
    for e in ENGINES:
        has = sid.endswith(f"_{e}") | sid.contains(f"_{e}_")
        engine = engine.when(has, e)
        mode = mode.when(has & sid.contains(f"_{e}_meso"), "meso").when(has & sid.contains(f"_{e}_micro"), "micro").when(has, "unknown")
        bare = sid
        for tail in (f"_{e}_meso", f"_{e}_micro", f"_{e}"):
            bare = F.replace(bare, F.lit(tail), F.lit(""))
        scenario = scenario.when(has, bare)
    return {"scenario": scenario.otherwise(whole), "engine": engine.otherwise("unknown"), "mode": mode.otherwise("unknown")}


def resolve(scenario: Column, engine: Column, mode: Column, scenario_id: Column) -> dict[str, Column]:
    """The given fields, and parts of the id for those that lack."""
    parsed = from_scenario_id(scenario_id)
    return {k: F.coalesce(given(x), parsed[k]) for k, x in (("scenario", scenario), ("engine", engine), ("mode", mode))}


def from_segments(scenario_id: Column) -> dict[str, Column]:
    """City, engine and mode from whole segments between underscores; mode ``meso`` where it has none."""
    parts = F.split(scenario_id, "_")
    engine = F
    for e in ENGINES:
        engine = engine.when(F.array_contains(parts, e), e)
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    left = F.array_join(F.filter(parts, lambda p: ~p.isin(*ENGINES, *MODE_WORDS)), "_")
    mode = F.when(has("micro", "microscopic"), "micro").otherwise("meso")
    return {"city": left, "engine": engine.otherwise("unknown"), "mode": mode}


def resolve_segments(scenario: Column, engine: Column, mode: Column, scenario_id: Column) -> dict[str, Column]:
    """The given fields, and segments of the id where any lacks; a mode is micro or meso in the end."""
    parsed = from_segments(scenario_id)
    named = F.coalesce(given(mode), parsed["mode"])
    return {
        "city": F.coalesce(given(scenario), parsed["city"]),
        "engine": F.coalesce(given(engine), parsed["engine"]),
        "mode": F.when(named.isin("micro", "meso"), named).when(named.contains("micro"), "micro").otherwise("meso"),
    }


def size_tier(city: Column) -> Column:
    """The first segment ``<n>k`` as a number, 0 without one: a sort key."""
    tiers = F.filter(F.split(city, "_"), lambda p: p.rlike("^[0-9]+k$"))
    return F.coalesce(F.regexp_replace(F.get(tiers, F.lit(0)), "k$", "").cast("int"), F.lit(0))


def name_tier(name: Column) -> Column:
    """Trips by the last ``<n>k`` or ``<n>m`` segment of a name, null without one."""
    found = F.regexp_extract_all(name, F.lit(r"(\d+[km])(?=_|$)"), 1)
    last = F.get(found, F.size(found) - 1)
    unit = F.when(last.endswith("m"), 1_000_000).otherwise(1_000)
    return F.regexp_replace(last, "[km]$", "").cast("bigint") * unit


def scenario_name(city: Column, trips: Column, modes: Column) -> Column:
    """``city_count_mode`` with a short count and sorted modes."""
    count = (
        F.when(trips >= 1_000_000, F.concat(F.floor(trips / 1_000_000).cast("string"), F.lit("m")))
        .when(trips >= 1_000, F.concat(F.floor(trips / 1_000).cast("string"), F.lit("k")))
        .otherwise(trips.cast("string"))
    )
    return F.concat_ws("_", city, count, F.array_join(F.array_sort(modes), "_"))


def short_mode(mode: Column) -> Column:
    return F.when(mode == "mesoscopic", "meso").when(mode == "microscopic", "micro").otherwise(mode)


def link_key(link_id: Column) -> Column:
    """Engine ids that are bare numbers get the prefix of links."""
    return F.when(link_id.rlike("^[0-9]+$"), F.concat(F.lit("l"), link_id)).otherwise(link_id)


def int_index(name: Column) -> Column:
    """The number behind a prefix of letters; anything else raises."""
    found = F.regexp_extract(name, "^[a-zA-Z]*([0-9]+)$", 1)
    return F.when(found != "", found.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no number in id "), F.coalesce(name, F.lit("null")))).cast("bigint"))


def one_line_error(error: Column, longest: int = 80) -> Column:
    """An error's first line without the prefixes that adapters add, with a count of further lines, cut between words."""
    prefixes = ("Conversion failed: ", "netconvert failed: ", "DTALite prep failed: ", "MATSim failed: ", "Error: ", "Warning: ")
    text = F.trim(F.coalesce(error, F.lit("")))
    for p in prefixes:  # each prefix in turn, as often as it repeats
        text = F.regexp_replace(text, f"^(?:{p})+", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.get(lines, F.lit(0))
    for p in ("Warning: ", "Error: "):
        head = F.regexp_replace(head, f"^{p}", "")
    more = F.size(lines) - 1
    suffix = F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")
    room = F.greatest(F.lit(10), F.lit(longest) - F.length(suffix))
    cut = F.substring(head, F.lit(1), room)
    words = F.regexp_replace(cut, " [^ ]*$", "")
    short = F.concat(F.when(words == "", cut).otherwise(words), F.lit("…"))
    line = F.concat(F.when(F.length(head) > room, short).otherwise(head), suffix)
    return F.when(F.size(lines) == 0, "unknown error").otherwise(line)
