"""Queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from factloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_equal(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in want.columns:
        assert (got[c] - want[c]).abs().max() < 1e-9 if got[c].dtype.kind == "f" else (got[c] == want[c]).all(), c
