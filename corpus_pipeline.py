"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage gets what the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark import scratch
from tallyspark.llm import decontam, ngram_join, packing, quality, toxicity

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5 stay; null and empty texts are scored as empty ones.

    Here as in the next stages each row is judged by its own values: null and repeated ids change nothing, repeated
    rows share one fate, other columns are passed on, and an empty table stays empty.
    """
    return toxicity.judge_documents(docs, _table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more stay; at exactly 0.5 a row is kept."""
    return quality.judge_documents(docs, _table(spark, sf_dir, "labels")).where("keep").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, with the least id of its class; texts without any word are one class.

    Two texts under one id are judged each for itself. A row without an id stays only where no copy of it has one.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no test item aligns with at the threshold stay; null and empty texts align with none."""
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence; null texts are packed as empty ones, repeated rows each for itself."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages fit models and align texts: SQL can't express them, so tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
