"""Worked cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import cache, context, routing, traffic


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return df.select(column(F.col("a"), F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("the ferry leaves at 6:15", "the ferry leaves at 7:15", False),
        ("rent is €900 a month", "rent is €950 a month", False),
        ("we need 12 chairs by noon", "by noon there must be 12 chairs", True),
        ("seat row QX-81", "seat row QX-82", False),
        ("7 and 7", "7", False),
        ("total 3.5.", "3.5", True),
    ],
)
def test_numbers(spark, a, b, same):
    assert one(spark, lambda A, B: text.numbers_match(A, B), a=a, b=b) is same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Does the lift work today?", "So the lift doesn't work today?", False),
        ("My key has not come. Who keeps it?", "My key has not come. When is the desk open?", True),
        ("May we park here?", "We may never park here, is that so?", False),
        ("I don’t know", "I don't know", True),
    ],
)
def test_negations(spark, a, b, same):
    assert one(spark, lambda A, B: text.negation_match(A, B), a=a, b=b) is same


def test_token_estimates_round_half_to_even(spark):
    got = spark.range(2000).select(text.tokens_of_words(F.col("id")).alias("t"), "id").collect()
    assert all(r.t == round(r.id * 1.3) for r in got)
    assert one(spark, lambda A, B: text.approx_tokens(A), a="bread and cheese for lunch") == 6
    assert one(spark, lambda A, B: text.word_count(A), a="a b c") == 3


def test_sentences_and_numbers_of_codes(spark):
    assert one(spark, lambda A, B: text.sentences(A), a=" One. Two!\n Three?No  end ") == ["One.", "Two!", "Three?No  end"]
    assert one(spark, lambda A, B: text.numbers(A), a="TR-40715, x") == ["40715"]
    assert one(spark, lambda A, B: text.clean(A), a=" a \n\t b ") == "a b"


@pytest.mark.parametrize(("words", "kept"), [("12 short but firm wooden planks", True), ("wooden planks 12", False), ("", False)])
def test_loose_facts(spark, words, kept):
    assert one(spark, lambda A, B: text.fact_kept_loose(A, B), a="12 wooden planks", b=words) is kept


def test_loose_fact_of_stop_words_only(spark):
    assert one(spark, lambda A, B: text.fact_kept_loose(A, B), a="to be or", b="not to me, be it or") is True


def test_small_helpers(spark):
    assert one(spark, lambda A, B: text.tenant_slug(A), a="Nord Öl & Co.") == "nord__l___co_"
    assert one(spark, lambda A, B: text.tenant_slug(A), a="") == "default"
    assert one(spark, lambda A, B: text.jaccard(A, B), a="a b c", b="b c d") == 0.5
    assert one(spark, lambda A, B: text.jaccard(A, B), a="", b="b") == 0.0
    assert one(spark, lambda A, B: text.verdict_of(A, ["better"]), a='x {"verdict": "better"} y') == "better"
    assert one(spark, lambda A, B: text.verdict_of(A, ["better"]), a="{broken") == "unparsed"
    assert one(spark, lambda A, B: text.says_same(A), a="  same, yes") is True
    assert one(spark, lambda A, B: traffic.cost(F.lit("large"), F.lit(1000), F.lit(100))) == 0.003
    assert one(spark, lambda A, B: routing.rules_route(A, F.lit(1)), a="This or that") == "large"
    assert one(spark, lambda A, B: routing.rules_route(A, F.lit(1)), a="Where is it?") == "small"


def test_cache_keys(spark):
    def key(q, c, d):
        return one(spark, lambda A, B: cache.cache_key(F.lit(q), F.lit(c).cast("string"), F.array(*map(F.lit, d))))

    base = key("q", "c", ["A", "B"])
    assert base == key("q", "c", ["B", "A"])
    assert key("q", None, ["A"]) == key("q", "", ["A"])
    assert len({base, key("q", "c", ["A", "C"]), key("q", "d", ["A", "B"]), key("Q", "c", ["A", "B"]), key("q", "c", ["A", "B", "B"])}) == 5


def test_rendering(spark):
    fields = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("id", "1"), ("state", "open"), ("gift", "False"))))
    assert one(spark, lambda A, B: context.render_case(F.lit("7"), F.lit(None).cast("string"), fields)) == "Order 7 for the signed-in customer.\n- state: open\n- gift: False"
    assert one(spark, lambda A, B: context.assemble(F.lit(None).cast("string"), F.array(F.lit("x"), F.lit("y")))) == "x\n\ny"
    assert one(spark, lambda A, B: context.assemble(F.lit("c"), F.array(F.lit("x")))) == "## Case\nc\n\nx"
