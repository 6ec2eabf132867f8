"""Output files of three engines: good, cut short, empty and absent."""

import gzip

from corridor.sources import cells

SUMO = b'<tripinfos><tripinfo id="a" duration="10"/><tripinfo id="b" duration="x"/><tripinfo id="c" duration="30"/></tripinfos>'
MATSIM = b"person;trav_time\n1;00:01:00\n2;00:00:00\n3;01:00:30\n"
DTALITE = b"travel_time,volume\n1,2\n2,\n0,9\n3,0.4\n"


def test_files_of_engines():
    assert cells._summary("sumo", SUMO) == ("success", None, 2, 20.0, 10.0)
    assert cells._summary("matsim", gzip.compress(MATSIM)) == ("success", None, 2, 1845.0, 3630.0)
    assert cells._summary("dtalite", DTALITE) == ("success", None, 3, 80.0, 60.0)
    cut = {"sumo": SUMO[:-5], "matsim": gzip.compress(MATSIM)[:-9], "dtalite": DTALITE + b"a,b"}
    for engine, content in cut.items():
        assert cells._summary(engine, content)[:3] == ("failed", cells.UNREADABLE[engine], 0)
        assert cells._summary(engine, b"")[:3] == ("failed", cells.MISSING.get(engine), 0)
    assert cells._summary("matsim", gzip.compress(b"person;trav_time\n"))[:2] == ("failed", "MATSim parser returned no stats")
    assert cells._summary("dtalite", b"travel_time,volume\n")[:2] == ("failed", None)


def test_runs_without_a_file_have_failed(spark, tmp_path):
    for engine, content in (("sumo", SUMO), ("matsim", MATSIM)):
        folder = tmp_path / f"engine={engine}" / "mode=meso" / "seed=1"
        folder.mkdir(parents=True)
        (folder / "part-0").write_bytes(content)  # the second is not packed
    planned = spark.createDataFrame([(e, "meso", s, 5) for e in ("sumo", "matsim", "dtalite") for s in (1, 2)], "engine string, mode string, seed int, timeout_s int")
    found = {(r["engine"], r["seed"]): (r["status"], r["error"], r["trips"]) for r in cells.recovered(planned, cells.read(spark, str(tmp_path))).collect()}
    late = ("failed", "DTALITE timeout after 5s", 0)
    assert found == {
        ("sumo", 1): ("success", None, 2), ("sumo", 2): ("failed", cells.MISSING["sumo"], 0), ("matsim", 1): ("failed", cells.UNREADABLE["matsim"], 0), ("matsim", 2): ("failed", cells.MISSING["matsim"], 0),
        ("dtalite", 1): late, ("dtalite", 2): late,
    }
