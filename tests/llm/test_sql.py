"""Queries of the text operators that have SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from photonlake.llm.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and got.dtypes[sorted(got)].tolist() == want.dtypes[sorted(want)].tolist()
    columns = sorted(got.columns)
    key = lambda df: sorted(df[columns].itertuples(index=False, name=None), key=repr)
    assert len(got) and key(got) == key(want)
