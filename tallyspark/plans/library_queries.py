"""Queries over what surrounds the model calls: keys, memo files, deleted entries, estimates, prices, vectors of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.operators import cache, context, models
from tallyspark.plans.tables import sections, sql_sentences, sql_tokens, table
from tallyspark.sources import records

#: Dollars per million tokens, in and out.
CONFIG = """
[prices]
small = [1, 5]
large = [3, 15]
"""
PROMPT, MODELS, MAX_TOKENS = "answer briefly", ["small", "large"], 512


def live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versioned cache key of each document's request: its language asks, its source and text are the documents."""
    version = records.config_version(PROMPT, MODELS, MAX_TOKENS)
    case = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("case "), F.col("doc_id") % 5))
    hashes = F.array(F.sha2("source", 256), F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", records.live_key(version, cache.cache_key(F.col("lang"), case, hashes)).alias("key"))


def memo_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memo of the even documents' answers takes in those of all documents: one a key, read again from its files."""
    answers = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("key"), F.left("text", F.lit(40)).alias("text"), F.lit("end_turn").alias("stop_reason"), F.lit("small").alias("model_used"), F.length("text").alias("input_tokens"), F.octet_length("text").alias("output_tokens")
    )
    path = scratch.fresh(spark, "memo")
    records.write_json(answers.where("doc_id % 2 = 0").drop("doc_id").dropDuplicates(["key"]), path)
    records.remember(records.read_memo(spark, path, records.MEMO_SCHEMA), answers.drop("doc_id"), path)
    return records.read_memo(spark, path, records.MEMO_SCHEMA)


def cleared_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each kind that are left when those of the first source are deleted, and how many went."""
    entries = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant"), F.when(F.col("doc_id") % 3 == 0, "exact").otherwise("semantic").alias("kind"))
    left, gone = cache.clear(entries, entries.agg(F.min("tenant")).first()[0])
    return cache.entry_counts(left).withColumn("gone", F.lit(gone).cast("long"))


def storable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a cache may keep: asked for with the cache, not refused, not blank; a stand-in for each question."""
    turns = table(spark, sf_dir, "conversations")
    stop = F.when(F.col("turn") % 7 == 0, "refusal").when(F.col("turn") % 3 > 0, "end_turn")
    return turns.select("conv_id", "turn", models.storable(F.col("turn") % 5 > 0, stop, F.when(F.col("role") == "assistant", F.col("text"))).alias("storable"), F.sha2(models.mock_answer(F.col("text")), 256).alias("mock_sha"))


def request_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request is thought to cost in tokens before it is sent."""
    return table(spark, sf_dir, "documents").select("doc_id", models.estimated_tokens(F.col("source"), F.col("text")).alias("tokens"))


def priced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by source and model at the configured prices, in micro-dollars; a model without a price has no cost."""
    model = F.element_at(F.array(*map(F.lit, ("small", "large", "other"))), (F.col("doc_id") % 3 + 1).cast("int"))
    calls = table(spark, sf_dir, "documents").select("source", model.alias("model"), F.col("n_chars").cast("long").alias("n_in"), (F.col("n_chars") % 100).cast("long").alias("n_out"))
    # Summed by model first: prices meet one row a group.
    sums = calls.groupBy("source", "model").agg(F.count("*").alias("n"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    told = sums.join(records.prices(spark, records.read_config(CONFIG)), "model", "left")
    return told.select("source", "model", "n", F.round(F.col("n_in") * F.col("price_in") + F.col("n_out") * F.col("price_out")).cast("long").alias("micros"))


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the vector of its text; the model (counts of characters) is asked once a distinct text."""
    vec = F.array(F.length("text"), F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit(""))))
    found = models.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda texts: texts.select("text", vec.alias("vec")))
    return found.select("doc_id", F.get("vec", F.lit(0)).alias("chars"), F.get("vec", F.lit(1)).alias("es"))


def united_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that three even documents repeat, with all sentences of pasted documents (every hundredth)."""
    rows = sections(spark, sf_dir)
    return context.united_boilerplate(context.boilerplate(rows.where("doc_id % 2 = 0")), context.boilerplate(rows.where("doc_id % 100 = 1"), least_docs=1))


QUERIES = {f.__name__: f for f in (live_keys, memo_appended, cleared_entries, storable_answers, request_estimates, priced_requests, embedded_texts, united_boilerplate)}

_VERSION = 'left(sha256(\'["answer briefly", ["small", "large"], 512]\'), 12)'

ORACLE_SQL = {
    "live_keys": f"""select doc_id, {_VERSION} || ':' || sha256('{{"case":"' || case when doc_id % 3 > 0 then 'case ' || (doc_id % 5) else '' end || '","docs":["'
        || least(sha256(source), sha256(text)) || '","' || greatest(sha256(source), sha256(text)) || '"],"query":"' || lang || '"}}') as key from documents""",
    "memo_appended": "select distinct sha256(text) as key, left(text, 40) as text, 'end_turn' as stop_reason, 'small' as model_used, length(text)::int as input_tokens, strlen(text)::int as output_tokens from documents",
    "cleared_entries": """with f as (select min(source) as s from documents)
        select case when doc_id % 3 = 0 then 'exact' else 'semantic' end as kind, count(*) as count, (select count(*) from documents, f where source = s) as gone from documents, f where source is distinct from s group by 1""",
    "storable_answers": """select conv_id, turn, turn % 5 > 0 and turn % 7 <> 0 and role = 'assistant' and length(coalesce(text, '')) > 0 as storable, sha256('[mock] ' || text) as mock_sha from conversations""",
    "request_estimates": f"select doc_id, floor({sql_tokens(chr(40) + 'source || chr(32) || text' + chr(41))} * 1.3::double)::int as tokens from documents",
    "priced_requests": """with c as (select source, case doc_id % 3 when 0 then 'small' when 1 then 'large' else 'other' end as model, n_chars as n_in, n_chars % 100 as n_out from documents),
        p(model, i, o) as (values ('small', 1, 5), ('large', 3, 15))
        select source, c.model, count(*) as n, sum(n_in * i + n_out * o)::bigint as micros from c left join p on p.model = c.model group by 1, 2""",
    "embedded_texts": "select doc_id, length(text)::int as chars, (length(text) - length(replace(text, 'e', '')))::int as es from documents",
    "united_boilerplate": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as body from documents),
        e as (select distinct doc_id, unnest({sql_sentences('body')}) as sentence from l where body <> '')
        select sentence from e where doc_id % 2 = 0 group by 1 having count(*) >= 3 union select sentence from e where doc_id % 100 = 1""",
}
