"""Every registered query runs, and equals its SQL where there is one (smallest scale)."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from seamwatch.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    rows = result.collect()
    assert len(set(result.columns)) == len(result.columns)
    if name in ORACLES:
        answer = duck.execute(ORACLES[name])
        columns = [c[0] for c in answer.description]
        assert table(result.columns, rows) == table(columns, answer.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
