import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_module

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "brightloom"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
