"""Registered queries against their SQL, and the package without its training-data part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from factloom.plans import catalog
from factloom.plans.inputs import TABLES

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if hasattr(value, "isoformat") or isinstance(value, (list, dict)) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = connection.sql(catalog.ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(found.columns)
    want = sorted((tuple(plain(dict(zip(result.columns, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) and len(catalog.QUERIES) >= 70


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_point_without_the_training_data_part(tmp_path, gone):
    """Exactly these are deleted; what is left imports, registers its queries, and its other tests are collected."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reconcile_revenue' in q and not any(x[:2] == 'op' and x[2].isdigit() or x == 'pipeline' for x in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}  # the copy, wherever the session's own path leads
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)
    if "llm" in gone:
        left = [sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"]
        subprocess.run(left, cwd=tmp_path / "repo", env=env, check=True, timeout=120, stdout=subprocess.DEVNULL)
        few = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_functions.py", "tests/test_models.py"]
        subprocess.run(few, cwd=tmp_path / "repo", env=env, check=True, timeout=600, stdout=subprocess.DEVNULL)


def test_whatever_else_the_training_data_part_lacks_is_an_error(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "spark-warehouse", "packing.py"))
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env=env, timeout=120, capture_output=True, text=True)
    assert found.returncode and "factloom.llm.packing" in found.stderr
