"""Rows that arrive on a stream are written by all tasks, and state has a partition for each core."""

import os

from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.plans import stream_queries


def test_parts_arrive_in_many_files(spark, monkeypatch):
    places, named = [], scratch.fresh
    monkeypatch.setattr(scratch, "fresh", lambda session, name: places.append(named(session, name)) or places[-1])
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("n"), F.timestamp_seconds("id").alias("at"))
    got = stream_queries.resumed(spark, rows, "n", "at", rows.limit(1).withColumn("n", F.lit(-1).cast("long")), lambda live: live.withColumn("twice", F.col("n") * 2))
    assert sorted(r.n for r in got.where("n >= 0").collect()) == list(range(4000))
    source = next(p for p in places if "stream-in" in p).removeprefix("file:").replace("///", "/")
    assert all(sum(f.endswith(".parquet") for f in os.listdir(f"{source}/{i}")) > 1 for i in range(stream_queries.FILES))


def test_state_has_a_partition_for_each_core(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "PARTITIONS", 1)
    with stream_queries._state_store(spark):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(min(4, spark.sparkContext.defaultParallelism))
