"""Every core query against its SQL in another engine."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from lodestrand.plans import core_queries, core_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = core_queries(), core_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in df.select(columns).collect())
    theirs = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert ours == sorted(repr(tuple(map(plain, r))) for r in theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
