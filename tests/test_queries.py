"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, small, con, key):
    df = entry.queries()[key](spark, small)
    cursor = con.execute(ORACLE[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
