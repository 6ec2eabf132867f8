"""Times of day as text and as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: arrival at work, 08:00.
ARRIVAL_S = 28_800


def hms_seconds(text: Column) -> Column:
    """Seconds of ``HH:MM:SS[.f]``; 0 for null and for anything else."""
    part = F.split(text, ":")
    number = lambda i, kind: F.get(part, F.lit(i)).try_cast(kind)
    total = number(0, "bigint") * 3600 + number(1, "bigint") * 60 + number(2, "double")
    return F.coalesce(F.when(F.size(part) == 3, total), F.lit(0.0))


def _two(x: Column) -> Column:
    digits = x.cast("string")
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def to_hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds; negative ones count as 0."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    return F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s / 60) % 60), _two(s % 60))


def to_hhmm(seconds: Column) -> Column:
    """``HH:MM`` of whole seconds."""
    s = seconds.cast("bigint")
    return F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s / 60) % 60))


def departure(commute_min: Column, start: int, end: int, arrival: int = ARRIVAL_S) -> Column:
    """Departure that arrives in time, kept within the horizon ``[start, end)``."""
    return F.greatest(F.lit(start), F.least(F.lit(end - 1), F.lit(arrival) - commute_min * 60)).cast("int")
