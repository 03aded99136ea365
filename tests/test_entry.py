"""The driver contract holds with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.oracle_sql()) - set(e.queries())))"


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_package(tmp_path):
    shutil.copytree(ROOT / "tesselar", tmp_path / "tesselar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, check=True)
    from tesselar import queries

    assert out.stdout.split()[0] == str(len(queries.QUERIES))
