"""The queries of the subpackage against their SQL in DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

from lectern.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_against_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(oracle.oracle_sql()[name])
    assert cols == sorted(want.columns)
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert rows(map(tuple, df.select(*cols).collect())) == rows(want.project(",".join(f'"{c}"' for c in cols)).fetchall())
