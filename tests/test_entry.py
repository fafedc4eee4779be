"""The entry file with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from workload.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
LOAD = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("left_out", [["logmix/llm"], ["logmix/llm", "corpus_pipeline.py"]])
@pytest.mark.parametrize("empty_folder", [False, True])
def test_loads_without_the_subpackage(tmp_path, left_out, empty_folder):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[p.split("/")[-1] for p in left_out]))
    if empty_folder:  # what is left where only the sources were deleted
        (copy / "logmix/llm/__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", LOAD], cwd=copy, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2, done.stderr
