"""The driver contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["record_id", "score", "metres"] and df.count() > 0


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "cartolith", tmp_path / "cartolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fold_text' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
