"""Event operators over streams: the same results as over tables, with bounds on lateness."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throughput(events: DataFrame, bin_size: str, late: str) -> DataFrame:
    """``bin, link, n``: vehicles (``at`` timestamp, ``type, link``) that enter each link by time bin.

    A bin is given out once no event may come for it: events later than ``late`` are left out.
    """
    entered = events.where("type = 'entered'").withWatermark("at", late)
    by = entered.groupBy(F.window("at", bin_size), "link").agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("bin"), "link", "n")


def visits(events: DataFrame, late: str, forget_ms: int) -> DataFrame:
    """``veh, link, t_in, t_out``: a leave (``at, type, veh, link, pos``) matches where its key's event just before is an enter.

    Events wait in a key's state until the watermark has passed them and are then paired in the
    order of ``at, pos``, whatever batch brought them; those later than ``late`` are left out. An
    enter without a leave goes ``forget_ms`` after the watermark passed it.
    """

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, held = json.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for rows in frames:
                held += map(list, zip(rows["us"].tolist(), rows["pos"].tolist(), (rows["type"] == "entered").tolist()))
        now = state.getCurrentWatermarkMs()
        held.sort()
        done = next((i for i, (us, *_) in enumerate(held) if us // 1000 >= now), len(held))
        out = []
        for us, _, enters in held[:done]:
            if enters:
                opened = us
            else:
                if opened is not None and us > opened:
                    out.append((*key, opened, us))
                opened = None
        held = held[done:]
        if not held and opened is not None and now >= opened // 1000 + forget_ms:
            opened = None
        if held or opened is not None:
            state.update((json.dumps((opened, held)),))
            state.setTimeoutTimestamp(max(now, held[0][0] // 1000 if held else opened // 1000 + forget_ms) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["veh", "link", "t_in", "t_out"])

    kept = events.where("type IN ('entered', 'left')").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    found = kept.groupBy("veh", "link").applyInPandasWithState(
        pair, "veh long, link long, t_in long, t_out long", "waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("veh", "link", F.timestamp_micros("t_in").alias("t_in"), F.timestamp_micros("t_out").alias("t_out"))
