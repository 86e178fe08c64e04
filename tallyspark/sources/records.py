"""Requests, cases, configuration and results: readers with declared schemas, and writers."""

from __future__ import annotations

import hashlib
import json
import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = (
    "id string, cluster_id string, variant string, expected_cache string, context_size string, difficulty string, query string, case_id string, answer_id string, "
    "attachments array<struct<doc_id: string, sections: array<string>>>, gold_doc_ids array<string>, gold_facts array<string>, must_not_claim array<string>, reference_answer string, "
    "exact_of string, semantic_of string, confusable_with string, suggested_model string, approx_context_tokens int"
)
JUDGE_SCHEMA = "cached string, new string, verdict string, raw string, input_tokens int, output_tokens int"
MEMO_SCHEMA = "key string, text string, stop_reason string, model_used string, input_tokens int, output_tokens int"
MODES = ("live", "replay", "mock")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled requests, a JSON object a line; ``seq`` is the number in the id, so that files may be split."""
    rows = spark.read.schema(QUERY_SCHEMA).json(path)
    return rows.withColumn("seq", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, fields): a JSON object of objects, the fields in their order and rendered as text."""
    whole = spark.read.text(path, wholetext=True)
    cases = whole.select("value", F.explode(F.json_object_keys("value")).alias("case_id"))
    body = F.expr("get_json_object(value, concat('$[\\'', case_id, '\\']'))")
    fields = cases.select("case_id", body.alias("body")).withColumn("keys", F.json_object_keys("body"))
    value = F.expr("transform(keys, k -> named_struct('k', k, 'v', get_json_object(body, concat('$[\\'', k, '\\']'))))")
    shown = F.transform(value, lambda f: F.struct(f.k.alias("k"), F.when(f.v.isin("true", "false"), F.initcap(f.v)).otherwise(f.v).alias("v")))
    return fields.select("case_id", shown.alias("fields"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, every column as text; callers cast what they use."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_memo(spark: SparkSession, path: str, schema: str = JUDGE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_config(text: str) -> dict[str, Any]:
    return tomllib.loads(text)


def prices(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """(model, price_in, price_out) in dollars per million tokens: one row a configured model."""
    return spark.createDataFrame([(m, float(p[0]), float(p[1])) for m, p in config["prices"].items()], "model string, price_in double, price_out double")


def config_version(prompt: str, models: list[str], max_tokens: int) -> str:
    """A fingerprint of what an answer depends on; part of every live key."""
    return hashlib.sha256(json.dumps([prompt, models, max_tokens]).encode()).hexdigest()[:12]


def live_key(version: str, key: Column) -> Column:
    return F.concat(F.lit(f"{version}:"), key)


def validated(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (query, budget, mode, doc_ids, attachments) that are sound, and the others with a reason.

    Attachments stand in place of doc_ids; a batch or a stream is split by the same expression.
    """
    attached = F.when(F.size("attachments") > 0, F.col("attachments")).otherwise(F.transform(F.coalesce("doc_ids", F.array().cast("array<string>")), lambda d: F.struct(d.alias("doc_id"), F.lit(None).cast("array<string>").alias("sections"))))
    length = F.length(F.coalesce("query", F.lit("")))
    reason = (
        F.when((length < 1) | (length > 4000), "query must have 1 to 4000 characters")
        .when(~F.coalesce(F.col("budget"), F.lit(800)).between(200, 8000), "budget must be 200 to 8000")
        .when(~F.coalesce(F.col("mode"), F.lit("mock")).isin(*MODES), "unknown mode")
        .when(F.size("attachments") == 0, "at least one document")
    )
    rows = requests.withColumn("attachments", F.coalesce(attached, F.array().cast("array<struct<doc_id: string, sections: array<string>>>"))).withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers; ``mode`` may be append. Arrays are joined by ``|``."""
    flat = df.select(*(F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def remember(memo: DataFrame, fresh: DataFrame, path: str) -> None:
    """Append the verdicts or answers that the memo doesn't hold, one a key."""
    keys = [c for c in ("cached", "new", "key") if c in memo.columns]
    fresh.join(memo.select(*keys), keys, "left_anti").dropDuplicates(keys).write.mode("append").json(path)
