"""Labels whose document is missing, whatever their id and whatever the document's language."""

import duckdb

from tallyspark import catalog


def test_each_orphan_is_reported_and_no_other(spark, tmp_path):
    spark.createDataFrame([(1, "en"), (5, "de"), (10, "en")], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (5, 0), (10, 1), (11, 0), (15, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted((r.id, r.rule) for r in catalog.QUERIES["label_references"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(catalog.ORACLE_SQL["label_references"]).fetchall()) == [(11, "label without document"), (15, "label without document")]
