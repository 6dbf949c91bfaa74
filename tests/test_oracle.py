"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from voxelmill.plans import catalog
from voxelmill.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    made = catalog.queries()[name](spark, SF)
    told = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows_of(made.columns, made.collect()) == rows_of(columns, told.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name, query in catalog.queries().items():
        if name not in catalog.oracle_sql():
            assert query(spark, SF).count() > 0, name
