import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from reliefspark.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["r", "c", "slope"] and df.count() == 500 * 64


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_optional_parts(tmp_path, pipeline):
    """The whole checkout without the training-text part, with and without the pipeline that needs it: everything else imports, and its tests are found."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for part in ("reliefspark/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "repo" / part, ignore_errors=True)
    if not pipeline:
        (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)
    env = {"PYTHONPATH": str(tmp_path / "repo"), "PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(*sorted(q)); print(*sorted(e.oracle_sql()))"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names, oracles = (x.split() for x in done.stdout.splitlines())
    assert names == oracles == sorted(catalog.queries())
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert found.returncode == 0 and "test_queries" in found.stdout and "llm" not in found.stdout, found.stdout
