"""Queries of the subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from tests.test_oracle import rows_of
from voxelmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    made = queries.queries()[name](spark, SF)
    told = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows_of(made.columns, made.collect()) == rows_of(columns, told.fetchall())
