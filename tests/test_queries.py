"""Every registered library query against its DuckDB counterpart on the smallest tables."""

import os

import duckdb
import pytest

from sampleyard.plans import queries

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in os.listdir(SMALL):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{SMALL}/{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    cursor = duck.execute(queries.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    theirs = sorted([tuple(plain(r[found.index(c)]) for c in columns) for r in cursor.fetchall()], key=str)
    assert [str(x) for x in mine] == [str(x) for x in theirs]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
