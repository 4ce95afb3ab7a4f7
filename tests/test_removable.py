"""The rest of the repository without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert "t04_seeds" in names and sql <= names, sorted(sql - names)
assert not any(n == "pipeline" or n.startswith("op") for n in names), names
"""


def copied(folder, without):
    """A copy of the repository without some folders and files; an emptied folder may stay behind."""
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    for name in without:
        path = folder / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    return folder


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_without_the_operators(tmp_path, left):
    gone = ["seqloom/llm", "tests/llm"] + ([] if left == "pipeline" else ["corpus_pipeline.py"])
    folder = copied(tmp_path / "repo", gone)
    if left == "empty folder":
        (folder / "seqloom/llm").mkdir()
    subprocess.run([sys.executable, "-c", CODE], cwd=folder, check=True)


def test_with_the_pipeline_and_an_emptied_folder(tmp_path):
    folder = copied(tmp_path / "repo", ["seqloom/llm", "tests/llm"])
    (folder / "seqloom/llm").mkdir()
    subprocess.run([sys.executable, "-c", CODE], cwd=folder, check=True)


def test_a_missing_part_is_an_error(tmp_path):
    if not (ROOT / "seqloom/llm/tables.py").exists():
        pytest.skip("the operators aren't there")
    folder = copied(tmp_path / "repo", ["seqloom/llm/tables.py"])
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True)
    assert done.returncode and "seqloom.llm.tables" in done.stderr
