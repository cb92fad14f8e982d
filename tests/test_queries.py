"""Each query beside its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ledgerleaf.plans.queries import ORACLE, QUERIES
from tests.conftest import TABLES


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return "~" if v is None else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, data, name):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    expected = duck.sql(ORACLE[name])
    assert sorted(expected.columns) == columns
    quoted = [f'"{c}"' for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in expected.select(*quoted).fetchall()), key=repr)
    assert mine == theirs
    assert mine


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"p9_text_heavy"}  # variances of pictures, tested on small ones


def test_pictures_of_documents(spark, data):
    assert {r.media_type for r in QUERIES["p9_text_heavy"](spark, data).collect()} <= {"image/png", "image/jpeg"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_stands_alone(tmp_path, pipeline):
    """Without the training-data folder, and with or without corpus_pipeline.py, the other queries are still there."""
    top = Path(__file__).parents[1]
    shutil.copytree(top / "ledgerleaf", tmp_path / "ledgerleaf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py") if pipeline else ("__spark_entry__.py",):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()))"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    assert told.stdout.strip() == str(sorted(QUERIES))
