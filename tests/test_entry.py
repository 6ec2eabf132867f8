"""The driver's contract with and without the optional folders."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q))"


def _listed(folder):
    run = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_import_without_the_optional_folders(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    n, pipeline, operators = _listed(bare)
    assert int(n) > 300 and (pipeline, operators) == ("False", "False")
    (bare / "corpus_pipeline.py").unlink()
    assert _listed(bare) == [n, "False", "False"]


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "scenario" in found.columns
