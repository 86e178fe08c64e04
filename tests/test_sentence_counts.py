"""Sentences of a stream are counted by hash: their texts are written once, with their batch, and looked up at the end."""

import functools

import pytest
from pyspark.sql import DataFrame

from tallyspark import scratch
from tallyspark.operators import context
from tallyspark.streaming import sentences


@pytest.fixture
def batches(spark):
    """Four batches of ten documents: their own sentences, one of all, some of few; repeated rows and ids, null ids."""
    rows = [[(10 * b + d, f"All say so. Own {b} {d}. Few say {d % 4}! Own {b} {d}.") for d in range(10)] for b in range(4)]
    rows[2] += [(21, "All say so. Twice."), (21, "Twice. Twice."), (None, "Twice. Null said."), (None, "Null said."), (29, None)]
    return [spark.createDataFrame(r, "doc_id long, body string") for r in rows]


def merged(spark, batches):
    kept = sentences.SentenceCounts(spark, scratch.fresh(spark, "counts"))
    for i, batch in enumerate(batches):
        kept.merge(batch, i)
    return kept


def test_texts_are_in_no_run_and_once_in_their_batch(spark, batches):
    kept = merged(spark, batches)
    runs = scratch.finished(spark, kept.path)
    assert runs and all("sentence" not in spark.read.parquet(f"{kept.path}/{run}").columns for run in runs)
    texts = spark.read.parquet(f"{kept.path}/texts/*")
    assert sorted(r.sentence for r in texts.collect()) == sorted(r.sentence for b in batches for r in context.hashed_sentences(b).collect())


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_counts_are_those_of_all_rows_whatever_the_filter_lets_through(spark, batches, monkeypatch, words):
    monkeypatch.setattr(context, "FILTER_WORDS", words)
    kept = merged(spark, batches)
    for n in (3, 4):
        every = functools.reduce(DataFrame.union, batches[:n])
        known = sorted(tuple(r) for r in context.boilerplate(every, 1).collect())
        for least in (1, 2, 3):
            want = [r for r in known if r[1] >= least]
            assert sorted(tuple(r) for r in kept.counts(n, least).collect()) == want
            assert sorted(tuple(r) for r in context.boilerplate(every, least).collect()) == want
    assert sorted(tuple(r) for r in kept.repeated().collect())[0] == ("All say so.", 40)


def test_boilerplate_counts_hashes_and_looks_up_what_is_repeated(batches, monkeypatch):
    tables, stage = [], scratch.stage
    monkeypatch.setattr(scratch, "stage", lambda df, name: tables.append(stage(df, name)) or tables[-1])
    every = functools.reduce(DataFrame.union, batches)
    found = context.boilerplate(every)
    assert [t.columns for t in tables] == [["h", "g", "n_docs"]]
    assert tables[0].count() == found.count() < context.boilerplate(every, 1).count()
