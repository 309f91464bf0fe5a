"""Every registered query equals its DuckDB oracle on the sf0.001 tables
(row count, column names and types, order-insensitive value hash, and the raw
values themselves)."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from duckdb_oracle import oracle_sql
from compare_oracle import TABLES, digest, spark_types

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert spark_types(df) == {c: str(t) for c, t in zip(ocols, con.sql(E.oracle_sql()[name]).types)}
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
    # stricter than the hash: the raw values are equal, floats included
    cols = sorted(df.columns)
    mine = sorted((tuple(r[df.columns.index(c)] for c in cols) for r in rows), key=repr)
    theirs = sorted((tuple(r[ocols.index(c)] for c in cols) for r in orows), key=repr)
    assert mine == theirs
