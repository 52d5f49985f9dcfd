"""Every registered query of the document operators runs, and equals its SQL where there is one (smallest scale)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from seamwatch.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
#: The first columns that a query returns; more may follow.
COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard", "op2": "query_id rank vec_id score", "op3": "doc_id n_lines n_dropped kept_sha256",
    "op4": "doc_id n_shingles component_id kept", "op5": "doc_id", "op6": "doc_id", "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8": "doc_id n_bytes n_removed n_spans kept_sha256", "op9": "doc_id held_out lang_pred score", "op10": "doc_id",
    "op11": "lang source part item value rank", "op12": "lang rank phrase a l r n score", "op13": "doc_id n_tokens ids_sha256 decoded_sha256"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in result.collect()]
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(result.columns) and len(set(result.columns)) == len(result.columns)
    if name in ORACLES:
        answer = duck.execute(ORACLES[name])
        columns = [c[0] for c in answer.description]
        assert table(result.columns, rows) == table(columns, answer.fetchall())


def test_each_operator_has_one_query():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14)) and "pipeline" in entry_module.queries()
