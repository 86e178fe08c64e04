"""Queries over routing: features, rules, router, thresholds and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import text
from tallyspark.operators import routing, traffic
from tallyspark.plans.tables import table


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a marker that makes some of them hard."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    tail = F.when(F.col("conv_id") % 5 == 0, F.lit(" or this instead?")).when(F.col("conv_id") % 5 == 1, F.lit(" That is all, right? ")).otherwise("")
    return rows.select("conv_id", "turn", F.concat("text", tail).alias("query"), (F.col("turn") % 3).cast("int").alias("docs"), F.length("text").alias("context_tokens"))


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.route_table(_queries(spark, sf_dir), "query", "docs", "context_tokens")
    return rows.select("conv_id", "turn", *routing.FEATURES[:7], F.bround("log_tokens", 6).alias("log_tokens"))


def rules_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("conv_id", "turn", routing.rules_route(F.col("query"), F.col("docs")).alias("route"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up probabilities, a hash of the id shifted by the label, stand in for out-of-fold ones; low quality is complex."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    p = F.pmod(F.col("doc_id") * 7919, F.lit(997)) / 997
    complex_ = F.col("quality") == 0
    return rows.select("doc_id", "lang", complex_.alias("complex"), F.bround(F.when(complex_, 0.31 + 0.69 * p).otherwise(0.8 * p), 6).alias("p_large"))


def safe_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.safe_threshold(_predictions(spark, sf_dir), ["lang"], 0.05)


def route_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five strategies side by side, each row scored once per strategy."""
    rows = _predictions(spark, sf_dir)
    small, large = F.lit(routing.SMALL), F.lit(routing.LARGE)
    each = {
        "router": F.when(F.col("p_large") >= 0.3, large).otherwise(small),
        "rules": F.when(F.col("doc_id") % 3 == 0, large).otherwise(small),
        "always_large": large,
        "always_small": small,
        "labels": F.when(F.col("complex"), large).otherwise(small),
    }
    told = rows.select("doc_id", "complex", F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), c.alias("route")) for n, c in each.items()))))
    return routing.score_routes(told, ["strategy"])


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and source, as a configuration: the share of good documents and the mean length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return rows.groupBy("lang", "source").agg(F.bround(F.avg("quality"), 4).alias("kept"), F.bround(F.avg("n_chars"), 2).alias("tokens"))


def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.best_config(_configs(spark, sf_dir), ["lang"], "kept", "tokens", "source")


def cheapest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.cheapest_within(_configs(spark, sf_dir), ["lang"], "kept", "tokens", "source")


def routing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    difficulty = F.when(F.col("quality") == 1, "easy").otherwise("complex")
    size = F.when(F.col("n_chars") >= 2000, "large").otherwise("small")
    told = routing.routing_label(difficulty, size)
    return rows.select("doc_id", told["suggested_model"].alias("suggested_model"), told["small_model_ok"].alias("small_model_ok"), told["depends_on_pruning"].alias("depends_on_pruning"))


def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources go to training or test by a seeded permutation; rows follow by semi and anti join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = [f"src{i}" for i in range(20)]
    train = spark.createDataFrame([(n,) for i, n in routing.shuffled(names, 7) if i < 10], "source string")
    return docs.join(F.broadcast(train), "source", "left_semi").withColumn("split", F.lit("train")).unionByName(docs.join(F.broadcast(train), "source", "left_anti").withColumn("split", F.lit("test"))).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


def router_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the router's features over their whole text, and the vector at the place of their id,
    modulo the number of vectors, in the order of vectors' ids."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    places = traffic.places(vecs, "vec_id")
    docs = table(spark, sf_dir, "documents").withColumn("docs", F.lit(1))
    # Features before the join, so that no text is shuffled.
    told = routing.route_table(docs, "text", "docs", "n_chars").select("doc_id", "lang", "source", *routing.FEATURES).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = told.withColumn("place", F.pmod("doc_id", F.lit(places.count()))).join(vecs.join(places, "vec_id"), "place")
    # The fit reads them many times.
    return scratch.stage(rows.drop("place", "vec_id").withColumn("needs_large", (F.col("quality") == 0).cast("double")), "router-rows")


def router_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router fitted on even documents, applied to odd ones: mean probability per language."""
    rows = router_rows(spark, sf_dir)
    score = routing.fit_router(rows.where("doc_id % 2 = 0"), "embedding", "needs_large")
    return score(rows.where("doc_id % 2 = 1")).groupBy("lang", "quality").agg(F.count("*").alias("n"), F.bround(F.avg("p_large"), 3).alias("mean_p"))


QUERIES = {f.__name__: f for f in (text_features, rules_route, safe_threshold, route_strategies, best_config, cheapest_config, routing_labels, split_membership, router_logreg)}

_Q = """q as (select conv_id, turn, text || case when conv_id % 5 = 0 then ' or this instead?' when conv_id % 5 = 1 then ' That is all, right? ' else '' end as query, (turn % 3)::int as docs, length(text) as context_tokens from conversations where role = 'user')"""
_P = "p as (select l.doc_id, lang, quality = 0 as complex, round_even(case when quality = 0 then 0.31::double + 0.69::double * (((l.doc_id * 7919) % 997) / 997) else 0.8::double * (((l.doc_id * 7919) % 997) / 997) end, 6) as p_large from labels l join documents using (doc_id))"
_C = "c as (select lang, source, round_even(avg(quality), 4) as kept, round_even(avg(n_chars), 2) as tokens from labels join documents using (doc_id) group by 1, 2)"
_RIGHT = r"regexp_replace(lower(query), '\s+$', '') like '%right?'"
_TRAIN = ", ".join(f"'{n}'" for i, n in routing.shuffled([f"src{i}" for i in range(20)], 7) if i < 10)

ORACLE_SQL = {
    "text_features": rf"""with {_Q} select conv_id, turn, len(regexp_extract_all(query, '\S+'))::int as n_words, len(regexp_extract_all(query, '[.!?]+'))::int as n_sentences, len(regexp_extract_all(query, '\?'))::int as n_questions,
        len(regexp_extract_all(query, '\d+'))::int as n_numbers, len(regexp_extract_all(query, '(?i)\b({'|'.join(text.CONNECTIVES)})\b'))::int as n_connectives, ({_RIGHT})::int as ends_right, docs as docs_kept, round_even(ln(1 + context_tokens), 6) as log_tokens from q""",
    "rules_route": f"with {_Q} select conv_id, turn, case when len(regexp_extract_all(query, '\\?')) > 1 or lower(query) like '% instead%' or lower(query) like '% or %' or {_RIGHT} or docs > 1 then 'large' else 'small' end as route from q",
    "safe_threshold": f"""with {_P}, g as (select round_even(unnest(range(1, 20)) * 0.05::double, 2) as threshold),
        r as (select lang, threshold, count(*) filter (complex and p_large < threshold) / greatest(1, count(*) filter (complex)) as rate from p cross join g group by 1, 2)
        select lang, coalesce(max(threshold) filter (rate <= 0.05::double), 0.05::double) as threshold from r group by 1""",
    "route_strategies": f"""with {_P}, s as (select doc_id, complex, 'router' as strategy, case when p_large >= 0.3 then 'large' else 'small' end as route from p union all select doc_id, complex, 'rules', case when doc_id % 3 = 0 then 'large' else 'small' end from p
        union all select doc_id, complex, 'always_large', 'large' from p union all select doc_id, complex, 'always_small', 'small' from p union all select doc_id, complex, 'labels', case when complex then 'large' else 'small' end from p)
        select strategy, count(*) as n, round_even(count(*) filter (route = 'small' and complex) / greatest(1, count(*) filter (complex)), 4) as complex_to_small,
          round_even(count(*) filter (route = 'large' and not complex) / greatest(1, count(*) filter (not complex)), 4) as easy_to_large, round_even(count(*) filter (route = 'small') / count(*), 4) as share_small from s group by 1""",
    "best_config": f"with {_C}, r as (select *, row_number() over (partition by lang order by kept desc, tokens, source) as k from c) select lang, source, kept, tokens from r where k = 1",
    "cheapest_config": f"""with {_C}, b as (select *, arg_min(kept, source) over (partition by lang) as base from c), r as (select *, row_number() over (partition by lang order by tokens, source) as k from b where kept >= base - 0.02::double)
        select lang, source, kept, tokens from r where k = 1""",
    "routing_labels": "select l.doc_id, case when quality = 1 then 'small' else 'large' end as suggested_model, quality = 1 as small_model_ok, n_chars >= 2000 as depends_on_pruning from labels l join documents using (doc_id)",
    "split_membership": f"select case when source in ({_TRAIN}) then 'train' else 'test' end as split, count(*) as n, count(distinct source) as n_sources from documents group by 1",
}
