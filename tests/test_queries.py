"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from photonlake.plans import files, queries

ORACLE, QUERIES = queries.ORACLE | files.ORACLE, queries.QUERIES | files.QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).map(lambda v: float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v).itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
