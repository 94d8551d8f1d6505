"""Every query with a SQL equivalent gives its rows."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from galegrid.plans import catalogue

TABLES = ["embeddings", "events", "lineitem"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found, want = catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = lambda some: sorted((tuple(map(plain, r)) for r in some), key=lambda r: [(v is None, v) for v in r])
    assert rows(found.select(columns).collect()) == rows(want.select(", ".join(columns)).fetchall())


def test_all_queries_are_registered():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_the_rest_does_without_the_optional_part(tmp_path):
    """On a copy without its folders and the pipeline, the entry point imports and has all other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/galegrid", tmp_path / "galegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert e.oracle_sql().keys() <= e.queries().keys()"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    assert set(said.stdout.split()) == set(catalogue.QUERIES)
