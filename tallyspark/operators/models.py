"""Embedding, answer and judge calls behind memo tables: each distinct input is asked for once, then joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import sampling

MOCK_OUTPUT_TOKENS = 120


def memoised(rows: DataFrame, inputs: list[str], memo: DataFrame, ask: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the memo's columns, and the new memo rows that ``ask`` gave for inputs the memo lacks.

    ``ask`` maps a table of distinct inputs to memo rows, by mapInPandas say. Without it, in offline mode, a missing
    input is an error. Memo keys are directional: (cached, new) isn't (new, cached).
    """
    missing = rows.select(*inputs).distinct().join(memo.select(*inputs), inputs, "left_anti")
    if ask is None:
        checked = rows.join(memo.withColumn("_known", F.lit(True)), inputs, "left")
        known = F.when(F.col("_known"), True).otherwise(F.raise_error(F.lit("offline: an input is not in the memo")).cast("boolean"))
        return checked.withColumn("_known", known).where("_known").drop("_known"), memo.limit(0)
    fresh = ask(missing)
    return rows.join(memo.unionByName(fresh), inputs, "left"), fresh


def embed(rows: DataFrame, column: str, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``vec``: the model sees every distinct text once, as (text), and returns (text, vec)."""
    vectors = model(rows.select(F.col(column).alias("text")).distinct())
    return rows.join(vectors.withColumnRenamed("text", column), column, "left")


def estimated_tokens(system: Column, user: Column) -> Column:
    """Where no tokenizer is at hand: the word estimate once more times 1.3, cut to a whole number."""
    return F.floor(text.approx_tokens(F.concat(system, F.lit(" "), user)) * F.lit(1.3)).cast("int")


def mock_answer(query: Column) -> Column:
    return F.concat(F.lit("[mock] "), query)


def storable(use_cache: Column, stop_reason: Column, answer: Column) -> Column:
    return use_cache & ~stop_reason.eqNullSafe(F.lit("refusal")) & (F.length(F.coalesce(answer, F.lit(""))) > 0)


def quality_verdict(own: Column, base: Column) -> Column:
    """equivalent, better or worse by the grades wrong, partial, correct; null if either grade is missing."""
    order = lambda g: F.when(g == "wrong", 0).when(g == "partial", 1).when(g == "correct", 2)
    a, b = order(own), order(base)
    return F.when(a == b, "equivalent").when(a > b, "better").when(a < b, "worse")


def graded(rows: DataFrame, grades: DataFrame, base: str = "baseline") -> DataFrame:
    """Adds own_grade, base_grade and verdict to rows (query_id, pipeline): offline grades (query_id, pipeline, grade) of the
    row's own pipeline and of the base one. A grade that is missing leaves the verdict null."""
    own = grades.select("query_id", "pipeline", F.col("grade").alias("own_grade"))
    first = grades.where(F.col("pipeline") == base).select("query_id", F.col("grade").alias("base_grade"))
    found = rows.join(own, ["query_id", "pipeline"], "left").join(first, "query_id", "left")
    return found.withColumn("verdict", quality_verdict(F.col("own_grade"), F.col("base_grade")))


def blinded(answers: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """What a grader sees of answers (query_id, pipeline, answer): (query_id, slot, answer), and the key (query_id, slot,
    pipeline) to it. Slots stand in an order that follows from seed, query and pipeline alone, so nothing tells pipelines
    apart, and a grader that is asked again sees the same."""
    order = sampling.keyed(F.lit(seed), F.col("query_id"), F.col("pipeline"))
    told = answers.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "pipeline")))
    return told.select("query_id", "slot", "answer"), told.select("query_id", "slot", "pipeline")


def blind_grades(answers: DataFrame, grader: Callable[[DataFrame], DataFrame], seed: int) -> DataFrame:
    """(query_id, pipeline, grade): ``grader`` maps (query_id, slot, answer) to (query_id, slot, grade)."""
    shown, key = blinded(answers, seed)
    return key.join(grader(shown).select("query_id", "slot", "grade"), ["query_id", "slot"]).select("query_id", "pipeline", "grade")
