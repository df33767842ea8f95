from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("__pycache__"))
    for path in ROOT.glob("*.py"):
        shutil.copy(path, tmp_path / path.name)
    return tmp_path


def names(folder):
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=folder, capture_output=True, text=True)


def test_without_the_training_data_subpackage(copy):
    shutil.rmtree(copy / "quarry/llm", ignore_errors=True)
    for leftover in (True, False):
        if not leftover:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        found = names(copy)
        assert found.returncode == 0 and "wordcount" in found.stdout and "pipeline" not in found.stdout.split()


def test_a_broken_part_is_an_error(copy):
    if not (copy / "quarry/llm").exists():
        pytest.skip("the subpackage is away")
    with open(copy / "quarry/llm/common.py", "a") as out:
        out.write("import no_module_of_this_name\n")
    found = names(copy)
    assert found.returncode and "no_module_of_this_name" in found.stderr
