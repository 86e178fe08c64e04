"""Streams fed from files, against the batch operators."""

import datetime
import functools
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.operators import context, traffic
from tallyspark.plans import stream_queries
from tallyspark.plans.tables import events
from tallyspark.streaming import requests, sentences


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir).where("event_id < 600")
    for i in range(3):
        rows.where(F.col("event_id").between(200 * i, 200 * i + 199)).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), rows


def drain(df, mode, name, path):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True).start()
    ended = query.awaitTermination(120)
    query.stop()
    assert ended
    return df.sparkSession.table(name)


def test_counters_equal_the_batch(stream, tmp_path):
    live, rows = stream
    got = drain(requests.counters(live), "complete", "counters", tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in requests.counters(rows).collect()}


def test_windows_equal_the_batch(stream, tmp_path):
    live, rows = stream
    got = drain(requests.rates(live, late="3650 days"), "update", "rates", tmp_path)
    last = got.groupBy("start", "layer").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in traffic.per_window(rows, "at", ["layer"], "1 minute").collect()}


def test_histograms_and_single_flight_run(stream, tmp_path):
    live, rows = stream
    got = drain(requests.latency_buckets(live, late="3650 days", length="3650 days"), "update", "buckets", tmp_path)
    assert got.agg(F.sum("le_inf")).first()[0] >= rows.where("seconds is not null").count()
    once = drain(requests.first_of_each(live, ["layer"], late="3650 days"), "append", "once", tmp_path)
    assert once.count() == rows.select("layer").distinct().count()


def moment(second):
    return datetime.datetime.fromtimestamp(second, datetime.UTC).replace(tzinfo=None)


def arriving(spark, batches):
    """A stream of one file a batch: rows are (tenant, key, event_id, second)."""
    schema = "tenant string, key string, event_id long, at timestamp"
    path = scratch.fresh(spark, "arriving")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(t, k, e, moment(s)) for t, k, e, s in rows], schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def answers(spark, batches, ttl, late, tmp_path):
    with stream_queries._state_store(spark):
        stream_queries._run(requests.cached(arriving(spark, batches), ttl, late), f"{tmp_path}/out", f"{tmp_path}/ck")
    return {r.event_id: (r.hit, r.served_from) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_an_early_row_that_comes_late_is_not_served_from_the_future(spark, tmp_path):
    batches = [[("a", "k", 2, 1000)], [("a", "k", 1, 10), ("a", "k", 3, 1050), ("a", "k", 3, 1050)], [("end", "end", 9, 10**6)]]
    assert answers(spark, batches, 100, "1 hour", tmp_path) == {1: (False, None), 2: (False, None), 3: (True, 2)}


def test_rows_behind_the_watermark_are_dropped_and_entries_end(spark, tmp_path):
    batches = [[("a", "k", 1, 100), ("a", "k", 2, 150)], [("b", "k", 3, 1000)], [("a", "k", 4, 120), ("a", "k", 5, 1001)], [("end", "end", 9, 10**6)]]
    got = answers(spark, batches, 100, "10 seconds", tmp_path)
    # Row 4 is 880 seconds old when the watermark stands at 990.
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None), 5: (False, None)}


def sentence_batches(spark, n, seed=5):
    """Sections of whole documents in batches; sentences recur across them, and a third of all rows hold the same one."""
    draw = random.Random(seed)
    said = [f"Sentence number {i}." for i in range(30)]
    rows = [[(b * 100 + d, " ".join(draw.sample(said, 3) + ["Common one."] * (draw.random() < 0.4))) for d in range(20) for _ in range(draw.choice((1, 2)))] for b in range(n)]
    rows[1] += [(900, None), (901, ""), (None, "Nobody's. Common one.")]
    return [spark.createDataFrame(r, "doc_id long, body string") for r in rows]


def test_runs_cover_all_batches_and_carry_like_a_counter():
    for n in range(1, 40):
        spans = [b for first, last in sentences.runs(n) for b in range(first, last + 1)]
        assert spans == list(range(n))
        assert len(sentences.runs(n)) == n.bit_count()


def test_sentences_are_counted_after_each_batch_as_over_all_rows(spark):
    kept = sentences.SentenceCounts(spark, scratch.fresh(spark, "counts"))
    assert kept.n_batches() == 0 and kept.counts().count() == 0
    batches = sentence_batches(spark, 6) + [spark.createDataFrame([], "doc_id long, body string")]
    for i, batch in enumerate(batches):
        kept.merge(batch, i)
        if i in (1, 3, 4):
            # A batch that failed after its table was written comes again.
            kept.merge(batch, i)
        every = functools.reduce(DataFrame.union, batches[: i + 1])
        again = sentences.SentenceCounts(spark, kept.path)
        assert again.n_batches() == i + 1
        assert {tuple(r) for r in again.repeated().collect()} == {tuple(r) for r in context.boilerplate(every).collect()}
    # Tables of batches that are settled are gone: what is left is read, or was carried by the last batch.
    assert len(scratch.finished(spark, kept.path)) <= len(set(sentences.runs(7)) | set(sentences.runs(6)))
