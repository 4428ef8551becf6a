"""The registered queries against DuckDB, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from hushframe.plans.oracles import SQL
from hushframe.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"image_counter_mapping"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    said = duck.execute(SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: repr([plain(v) for v in row])
    ours = sorted(key([r[c] for c in sorted(columns)]) for r in got.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert ours == sorted(key([row[i] for i in order]) for row in said.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_there_are_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
