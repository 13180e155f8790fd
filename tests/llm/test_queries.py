"""The registered queries: each runs over whole tables, and those with SQL give its rows."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{DATA}/{table}'")
    got, wanted = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    rows = lambda frame: sorted(map(repr, frame[sorted(frame.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(wanted)


def test_all_are_registered():
    known = entry.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in known)] == []
    assert "pipeline" in known


@pytest.mark.parametrize("name", ["op1_simhash", "op3_quality", "op4_linededup", "op5_mixing", "op6_lmscore", "op7_tokencount", "op9_rules", "op12_tokenfiles", "op13_alignment"])
def test_a_row_for_each_document(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    assert QUERIES[name](spark, DATA).select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
