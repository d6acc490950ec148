"""The entry module with and without the optional training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPOSITORY = Path(__file__).resolve().parents[1]

_LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def _names(folder: Path) -> set[str]:
    run = subprocess.run([sys.executable, "-c", _LIST], cwd=folder, capture_output=True, text=True, check=True)
    return set(run.stdout.split())


def _copy(target: Path, *left_out: str) -> Path:
    shutil.copytree(REPOSITORY, target, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
    return target


def test_without_the_optional_folders(tmp_path):
    bare = _names(_copy(tmp_path / "bare", "llm"))
    assert "cohort_retention" in bare and "pipeline" not in bare
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in bare)
    no_pipeline = _names(_copy(tmp_path / "no_pipeline", "llm", "corpus_pipeline.py"))
    assert no_pipeline == bare
