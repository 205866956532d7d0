"""Each query with SQL agrees with it in DuckDB, on the small tables; the others run."""

import os

import duckdb
import pytest

from ferrule.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


def values(rows, columns):
    return sorted(repr([r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in df.collect()]
    if name in ORACLE_SQL:
        answer = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in answer.description]
        assert sorted(df.columns) == sorted(names)
        assert values(rows, sorted(names)) == values([dict(zip(names, r, strict=True)) for r in answer.fetchall()], sorted(names))
