"""Which texts move: sentences meet by hash, words are taken once, and requests follow from ids."""

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import context
from tallyspark.plans import context_queries, tables


def optimised_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_text_are_taken_once_for_all_facts(spark, sf_dir):
    plan = optimised_plan(context_queries.fact_coverage(spark, sf_dir))
    assert plan.count("regexp_extract_all(lower(text") == 1
    row = spark.range(1).select(text.facts_kept_loose([F.lit("red box"), F.lit("box red")], F.lit("A red wooden box")).alias("x")).first()
    assert row.x == [True, False]


def test_boilerplate_meets_by_hash_and_moves_no_sentence(spark):
    sections = spark.createDataFrame([(d, p, "Same here. Own %d %d. Same here." % (d, p)) for d in range(4) for p in range(2)], "doc_id long, pos int, body string")
    known = context.boilerplate_hashes(sections)
    assert {r.h for r in known.collect()} == {r.h for r in context.boilerplate(sections).select(F.xxhash64("sentence").alias("h")).collect()}
    places = context.repeated_places(sections, known, ["doc_id", "pos"])
    assert places.columns == ["doc_id", "pos", "i"] and {r.i for r in places.collect()} == {0, 2}
    assert [r.n_repeated for r in context.strip_boilerplate(sections, known, drop_ratio=0.7).collect()] == [2] * 8


def test_sections_are_numbered_without_a_join(spark, sf_dir):
    assert "Join" not in optimised_plan(tables.chunks(spark, sf_dir))
