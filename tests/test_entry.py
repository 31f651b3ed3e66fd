"""The driver's entry, with the training-data operators and without them."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice", "customer_c_name", "customer_nation_n_name"]
    assert 0 < len(df.collect()) <= 50
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["plumbline/llm", "tests/llm", "corpus_pipeline.py"], ["plumbline/llm"], ["corpus_pipeline.py"]])
def test_without_the_training_operators(tmp_path, gone):
    for part in ("plumbline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (TOP / part).is_dir():
            shutil.copytree(TOP / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif (TOP / part).exists():
            shutil.copy(TOP / part, tmp_path)
    for part in gone:
        where = tmp_path / part
        shutil.rmtree(where) if where.is_dir() else where.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); print('fine')"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert got.stdout.strip() == "fine", got.stderr[-800:]


def test_without_a_library_that_they_need(tmp_path):
    """numpy can't be imported: the queries of the rest are there."""
    (tmp_path / "numpy").mkdir()
    (tmp_path / "numpy" / "__init__.py").write_text("raise ImportError('none here', name='numpy')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q); print('fine')"
    got = subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{TOP}"})
    assert got.stdout.strip() == "fine", got.stderr[-800:]


def test_nothing_else_imports_them():
    for path in (TOP / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(TOP).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
