"""Output folders of runs: a file each, read by the kind of its engine. A file that cannot be read makes a failed row, not a failed job.

Files are read whole, one after another in a task: what a task holds is bounded by a run's file.
"""

from __future__ import annotations

import csv
import gzip
import io
import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is said of a run whose file is absent, or is there but not readable, or holds nothing.
MISSING = {"sumo": "Cell artifact missing: tripinfo.xml", "matsim": "Cell artifact missing: output/output_trips.csv.gz"}
UNREADABLE = {"sumo": "tripinfo parse failed", "matsim": "MATSim parse failed", "dtalite": "DTALite parse failed"}
NOTHING = {"matsim": "MATSim parser returned no stats"}
KEYS = ["engine", "mode", "seed"]


def _seconds(text: str) -> float:
    h, m, s = text.split(":")
    return int(h) * 3600 + int(m) * 60 + float(s)


def _times(engine: str, content: bytes) -> list[tuple[float, int]]:
    """Travel times with their number of trips."""
    if engine == "sumo":
        out = []
        for _, x in ET.iterparse(io.BytesIO(content)):
            if x.tag == "tripinfo":
                try:
                    out.append((float(x.get("duration", "")), 1))
                except ValueError:
                    pass  # one bad trip
            x.clear()
        return out
    text = (gzip.decompress(content) if engine == "matsim" else content).decode("utf-8")
    rows = csv.DictReader(io.StringIO(text), delimiter=";" if engine == "matsim" else ",")
    if engine == "matsim":
        return [(t, 1) for r in rows if (t := _seconds(r["trav_time"])) > 0]
    return [(60 * t, n) for r in rows if (t := float(r["travel_time"])) > 0 and (n := round(float(r["volume"] or 1))) > 0]


def _summary(engine: str, content: bytes) -> tuple[str, str | None, int, float, float]:
    """Status, error, trips, mean and p95 of a file."""
    if not content:
        return "failed", MISSING.get(engine), 0, 0.0, 0.0
    try:
        times = sorted(_times(engine, content))
    except Exception:  # whatever a broken file raises
        return "failed", UNREADABLE[engine], 0, 0.0, 0.0
    n = sum(k for _, k in times)
    if not n and engine != "sumo":
        return "failed", NOTHING.get(engine), 0, 0.0, 0.0
    at = min(math.floor(0.95 * n), n - 1) if engine == "matsim" else math.floor(0.95 * (n - 1))
    p95 = 0.0
    for t, k in times:
        if at < k:
            p95 = t
            break
        at -= k
    return "success", None, n, sum(t * k for t, k in times) / n if n else 0.0, p95


def read(spark: SparkSession, path: str) -> DataFrame:
    """``engine, mode, seed, status, error, trips, mean_tt, p95_tt`` of every file below ``engine=/mode=/seed=`` folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    rows = files.select(part("engine").alias("engine"), part("mode").alias("mode"), part("seed").cast("int").alias("seed"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
        for batch in batches:
            found = [_summary(e.as_py(), c.as_py()) for e, c in zip(batch.column(0), batch.column(3))]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], [*KEYS, "status", "error", "trips", "mean_tt", "p95_tt"])

    return rows.mapInArrow(run, "engine string, mode string, seed int, status string, error string, trips long, mean_tt double, p95_tt double")


def recovered(planned: DataFrame, found: DataFrame) -> DataFrame:
    """Every planned run (``engine, mode, seed, timeout_s``) with what its file says; one without a file, or an assignment without a trip, has failed."""
    rows = planned.join(found, KEYS, "left")
    absent = F.col("status").isNull()
    why = F
    for engine, text in MISSING.items():
        why = why.when(absent & (F.col("engine") == engine), text)
    late = F.concat(F.lit("DTALITE timeout after "), "timeout_s", F.lit("s"))
    failed = absent | (F.col("status") == "failed")
    error = F.coalesce("error", why.when(failed & (F.col("engine") == "dtalite"), late))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*KEYS, F.coalesce("status", F.lit("failed")).alias("status"), error.alias("error"), zero("trips"), zero("mean_tt").cast("double").alias("mean_tt"), zero("p95_tt").cast("double").alias("p95_tt"))
