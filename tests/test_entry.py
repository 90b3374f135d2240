"""The entry file with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTING = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LISTING], cwd=folder, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": ""}).stdout
    names, sql = out.split("|")
    return set(names.split()), set(sql.split())


def copied(folder, *without):
    gone = {os.path.join(ROOT, x) for x in (".git", *without)}
    shutil.copytree(ROOT, folder, ignore=lambda d, names: [
        n for n in names if os.path.join(d, n) in gone or n in ("__pycache__", "spark-warehouse")])
    return folder


@pytest.mark.parametrize("without", [
    ("fundflow/llm", "tests/llm", "corpus_pipeline.py"),
    ("fundflow/llm", "tests/llm"),
])
def test_ledger_queries_stand_alone(tmp_path, without):
    """Without the subpackage the ledger queries are all there, and every remaining test file loads."""
    import __spark_entry__ as e

    folder = copied(tmp_path / "copy", *without)
    names, sql = listed(folder)
    assert names == sql == set(e.SCENARIOS)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"],
                          cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stdout[-2000:]


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "fundflow", "llm")), reason="the subpackage is not there")
def test_training_data_queries_come_with_the_subpackage(tmp_path):
    import __spark_entry__ as e

    whole, _ = listed(ROOT)
    assert {n for n in whole if n.startswith("op")} and set(e.SCENARIOS) < whole
    alone, _ = listed(copied(tmp_path / "copy", "corpus_pipeline.py"))
    assert alone == whole - {"pipeline"}
