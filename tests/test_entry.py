import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names(cwd):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=cwd, env={**os.environ, "PYTHONPATH": str(cwd)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    lines = dict(line.split(" ", 1) for line in out.stdout.splitlines())
    return set(lines["NAMES"].split()), set(lines["SQL"].split())


@pytest.fixture
def bare(tmp_path):
    """The repository without the training-data operators."""
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_registry_without_training_operators(bare):
    queries, sql = names(bare)
    assert len(queries) > 100 and sql <= queries
    assert not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries


WHOLE = (ROOT / "corpus_pipeline.py").exists() and (ROOT / "tessera" / "llm").exists()


@pytest.mark.skipif(not WHOLE, reason="training-data operators are left out")
def test_registry_with_training_operators():
    queries, sql = names(ROOT)
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in queries and sql <= queries


def test_pipeline_without_its_operators(bare):
    """The pipeline's file may stay when the operators go."""
    (bare / "corpus_pipeline.py").write_text("from tessera.llm import exact\n")
    queries, _ = names(bare)
    assert "pipeline" not in queries


def test_other_missing_modules_are_not_hidden(bare):
    (bare / "corpus_pipeline.py").write_text("import no_such_module\n")
    code = "import __spark_entry__"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=bare, env={**os.environ, "PYTHONPATH": str(bare)}, capture_output=True, text=True, timeout=120)
    assert out.returncode and "no_such_module" in out.stderr


def test_nothing_outside_imports_the_training_operators():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(import|from)\s+\S*\bllm\b|import llm", path.read_text())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.count() == 20 and got.columns[0] == "context_id"
