"""Attributes of roads from map tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes by rank, with default speed in m/s and lanes.
CLASSES = {
    "motorway": (33.3, 3),
    "motorway_link": (22.2, 1),
    "trunk": (27.8, 2),
    "trunk_link": (19.4, 1),
    "primary": (22.2, 2),
    "primary_link": (16.7, 1),
    "secondary": (16.7, 2),
    "secondary_link": (13.9, 1),
    "tertiary": (13.9, 1),
    "tertiary_link": (11.1, 1),
    "residential": (11.1, 1),
    "living_street": (5.6, 1),
    "unclassified": (11.1, 1),
    "service": (8.3, 1),
}
SPEED, LANES = 13.9, 1
#: Kinds of buildings that are schools.
SCHOOLS = ("school", "kindergarten", "preschool", "college", "university")
#: Codes of the way to work by mode; others go by car.
COMMUTE_MODES = {"car": (1, 7, 8), "transit": (2, 3, 4, 5, 6), "bike": (9,), "walk": (10,), "home": (11, 12)}
#: Width of a class on a map; others are drawn like residential ones.
STYLES = (
    (("motorway", "motorway_link", "trunk", "trunk_link"), 1.0),
    (("primary", "primary_link", "secondary", "secondary_link"), 0.7),
    (("tertiary", "tertiary_link", "residential", "unclassified"), 0.4),
    (("living_street", "service", "track"), 0.25),
    (("footway", "cycleway", "pedestrian", "path", "steps"), 0.15),
)


def _by_class(road: Column, values: dict, rest) -> Column:
    out = F
    for name, v in values.items():
        out = out.when(road == name, F.lit(v))
    return out.otherwise(F.lit(rest))


def speed_mps(tag: Column, road: Column) -> Column:
    """Speed in m/s from a tag in km/h or mph, else by class; one decimal."""
    low = F.lower(tag)
    value = F.trim(F.replace(F.replace(low, F.lit("mph"), F.lit("")), F.lit("km/h"), F.lit(""))).try_cast("double")
    read = F.when(low.contains("mph"), value * 0.44704).otherwise(value / 3.6)
    return F.bround(F.coalesce(read, _by_class(road, {k: v[0] for k, v in CLASSES.items()}, SPEED)), 1)


def lanes(tag: Column, road: Column) -> Column:
    """Lanes from a whole number, else by class."""
    whole = F.when(F.trim(tag).rlike(r"^[+-]?\d+$"), F.trim(tag).try_cast("int"))
    return F.coalesce(whole, _by_class(road, {k: v[1] for k, v in CLASSES.items()}, LANES))


def pick_first(tags: Column) -> Column:
    """The least of several tags as text, null of none."""
    return F.array_min(tags)


def pick_class(tags: Column) -> Column:
    """The most significant class of several, unknown ones last and by name; residential of none."""
    rank = lambda t: _by_class(t, {k: i for i, k in enumerate(CLASSES)}, len(CLASSES))
    best = F.array_min(F.transform(tags, lambda t: F.struct(rank(t).alias("rank"), t.alias("name"))))
    return F.coalesce(best["name"], F.lit("residential"))


def node_type(degree: Column) -> Column:
    return F.when(degree <= 2, "dead_end").when(degree >= 6, "major_intersection").otherwise("intersection")


def is_school(kind: Column) -> Column:
    """Whether a building's kind, up to its first colon, is a school."""
    return F.coalesce(F.get(F.split(F.trim(F.lower(kind)), ":"), F.lit(0)).isin(*SCHOOLS), F.lit(False))


def mode_of(code: Column) -> Column:
    out = F
    for mode, codes in COMMUTE_MODES.items():
        out = out.when(code.isin(*codes), mode)
    return out.otherwise("car")


def line_width(road: Column) -> Column:
    out = F
    for names, width in STYLES:
        out = out.when(road.isin(*names), width)
    return out.otherwise(0.4)


def way_ids(text: Column) -> Column:
    """The ids of ``123`` or ``[1, 2]``; parts that are no whole number are dropped."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p).try_cast("bigint")), lambda x: x.isNotNull())
