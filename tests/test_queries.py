"""Every registered query of the main library against its DuckDB SQL, with equal column names and values."""

import os

import duckdb
import pytest

from tallyspark import catalog

ROWS_ONLY = sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys())


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        connection.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in rows.fetchall())))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert entry.oracle_sql().keys() <= entry.queries().keys()
