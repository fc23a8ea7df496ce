"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("tidewater/llm", "corpus_pipeline.py"), ("tidewater/llm",), ("corpus_pipeline.py",)])
def test_entry_without_parts(tmp_path, gone):
    for name in ("tidewater", "__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    for name in gone:
        (shutil.rmtree if (tmp_path / name).is_dir() else Path.unlink)(tmp_path / name) if (tmp_path / name).exists() else None
    code = "import __spark_entry__ as e; print(*e.queries())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    found = said.stdout.split()
    assert "cdc_replay" in found and "pipeline" not in found
    assert any(n.startswith("op1_") for n in found) == (tmp_path / "tidewater/llm").exists()


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "tidewater").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "tidewater.llm" not in path.read_text(), path
