"""Every query against its SQL in DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import oracle, queries

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


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_without_sql(spark, name):
    assert queries.queries()[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("phrase", "day"), [("last thursday", "2025-04-10"), ("this thursday", "2025-04-17"), ("latest sermon", "2025-04-16"), ("past sun", "2025-04-13"), ("may 18", "2024-05-18"), ("feb 29", None), ("February 29 2024", "2024-02-29"), ("2025-13-01", None), ("last month", None), (None, None)])
def test_dates(spark, phrase, day):
    from pyspark.sql import functions as F

    from lectern.functions.dates import resolve_date

    got = spark.range(1).select(resolve_date(F.lit(phrase).cast("string"), F.lit("2025-04-17").cast("date")).cast("string").alias("d")).first().d
    assert got == day
