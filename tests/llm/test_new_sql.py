import duckdb
import pytest

from tallyspark.llm import queries


@pytest.mark.parametrize("name", ["op11_spelling", "op12_conversation_repair", "op13_substring_dedup"])
def test_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = duck.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})")
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, rows.fetchall()))
