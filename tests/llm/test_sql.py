"""The operators that SQL can state, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sampleyard.llm import queries

from . import odd


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in os.listdir(odd.SMALL):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{odd.SMALL}/{p}'")
    df = queries.queries()[name](spark, odd.SMALL)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=key)
