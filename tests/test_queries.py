"""Every registered query of the engine against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemill import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def values(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    assert values(df.collect(), columns, df.columns) == values(got.fetchall(), columns, names)
