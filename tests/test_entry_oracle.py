"""Every registered query runs on sf0.001 and matches its DuckDB oracle."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.collect()) > 0


@pytest.fixture(scope="module")
def duck():
    from tablecare.plans.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _names():
    import __spark_entry__ as E
    return sorted(E.queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from oracle_check import rows_of
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = rows_of([tuple(r) for r in df.collect()], cols)
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    assert got == rows_of(cur.fetchall(), ocols)
