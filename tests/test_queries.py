"""Every query with SQL gives the same rows as DuckDB; the others run."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from rosterspark.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = oracle.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_others_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point():
    import __spark_entry__

    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert SQL.keys() <= __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_point_without_the_training_data_package(monkeypatch):
    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith(("rosterspark.llm", "corpus_pipeline"))] + ["rosterspark.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert __spark_entry__.queries().keys() == QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() == SQL.keys()


def test_entry_point_where_only_compiled_leftovers_are_there(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "rosterspark", tmp_path / "rosterspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "rosterspark" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(SQL))]
