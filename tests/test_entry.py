import os
import pathlib
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


def test_contract_without_the_training_data_operators(tmp_path):
    """What is left works where fluvius/llm and tests/llm are deleted, corpus_pipeline.py being there or not."""
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "fluvius", tmp_path / "fluvius", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path) if (root / name).exists() else None
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "pipeline" not in said.stdout.split() and "runs_smoothed" in said.stdout.split()
