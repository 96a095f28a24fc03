import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_have_the_same_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 100


@pytest.mark.parametrize("left_over", [False, True])
def test_works_without_the_training_data_part(tmp_path, left_over):
    """Without the two folders and corpus_pipeline.py, also if an empty folder stays: imports, a query, the other tests are found."""
    for p in (ROOT / "iotrail", ROOT / "tests"):
        copy = tmp_path / p.name
        copy.mkdir()
        for x in p.iterdir():
            if x.name not in ("llm", "__pycache__"):
                (copy / x.name).symlink_to(x)
    if left_over:
        (tmp_path / "iotrail/llm/__pycache__").mkdir(parents=True)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"} | {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "SPARK_HOME", "SPARK_LOCAL_IP")}
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert found.returncode == 0 and "test_derive" in found.stdout, found.stdout + found.stderr


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
