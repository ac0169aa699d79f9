"""The rest of the library without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(x for x in e.queries() if x.startswith('op') and x[2].isdigit()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline_stays):
    for name in ("__spark_entry__.py", "tidemark"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    if pipeline_stays and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, _, numbered, has_pipeline = out.stdout.strip().split("\n")[-1].split(" ", 3)
    assert int(n) > 100 and numbered == "[]" and has_pipeline == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidemark.llm" not in path.read_text(), path
