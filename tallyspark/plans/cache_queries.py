"""Queries over caches: exact and semantic replay, guards, nearest entries, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import text, vectors
from tallyspark.operators import cache, traffic
from tallyspark.operators import signed as replays
from tallyspark.plans.tables import SQL_EVENTS, SQL_REQUESTS, SQL_TURNS, events, requests, sql_tokens, table, turns

#: The embeddings of the tables are nearly orthogonal: the library's 0.90 would find nothing.
THETA = 0.30
GRID = tuple(round(THETA + 0.01 * i, 2) for i in range(30))
MODES = ("cosine", "context", "guards")
#: What traps are made of, by the document's number.
TRAPS = ("tricky_number", "tricky_negation", "tricky_intent", "tricky_case", "tricky_state", "edge")
#: Documents of a source and language that agree in so many first characters are expected to give one answer.
CLUSTER_CHARS = 40
REASONS = ("low_cosine", "context_mismatch", "numbers_mismatch", "negation_mismatch", "empty")


def exact_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", cache.cache_key(F.col("text"), F.lit(None).cast("string"), F.array(F.col("lang"))).alias("key"), text.approx_tokens(F.col("text")).alias("tokens"))
    found = cache.exact_replay(rows, "key", "doc_id")
    return found.select("doc_id", "hit", "served_from", F.when(F.col("hit"), F.col("tokens")).otherwise(0).alias("tokens_saved"), "tokens")


def exact_cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cache did against what is expected: later documents of a cluster (those of a source and language that
    begin alike) should be served from its first one. Edited copies miss or come from a wrong source, and copies from
    other sources hit where nothing is expected."""
    docs = table(spark, sf_dir, "documents")
    cluster = F.sha2(F.concat_ws("|", F.col("source"), F.col("lang"), F.left(F.col("text"), F.lit(CLUSTER_CHARS))), 256)
    rows = docs.select("doc_id", cache.cache_key(F.col("text"), F.lit(None).cast("string"), F.array(F.col("lang"))).alias("key"), cluster.alias("cluster"), text.approx_tokens(F.col("text")).alias("tokens"))
    rows = cache.exact_replay(rows, "cluster", "doc_id").withColumnsRenamed({"hit": "expected", "served_from": "expected_source"})
    out = cache.exact_replay(rows, "key", "doc_id").withColumn("tokens_saved", F.when(F.col("hit"), F.col("tokens")).otherwise(0))
    expected = F.col("expected")
    out = out.withColumn("outcome", cache.exact_outcome(F.col("hit"), expected, F.col("served_from"), F.col("expected_source")))
    hits, total = F.count_if("hit"), F.count("*")
    return out.agg(
        total.alias("queries"),
        hits.alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("true_hit", "false_hit", "wrong_source", "missed_hit", "true_miss")),
        F.bround(F.count_if(F.col("outcome") == "true_hit") / F.nullif(F.count_if(expected), F.lit(0)), 4).alias("recall"),
        F.bround(F.count_if(F.col("outcome") == "true_hit") / F.nullif(hits, F.lit(0)), 4).alias("precision"),
        F.bround(hits / total, 4).alias("hit_rate"),
        F.sum("tokens").alias("context_tokens_total"),
        F.sum("tokens_saved").alias("context_tokens_saved"),
        F.bround(F.sum("tokens_saved") / F.sum("tokens"), 4).alias("tokens_saved_pct"),
    )


def cache_key_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the same priority, status and multiset of parts share a key, whatever the line order."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.sha2(F.col("l_partkey").cast("string"), 256))).alias("docs"))
    rows = table(spark, sf_dir, "orders").join(parts, "o_orderkey")
    return rows.select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus", F.array_join("docs", ",")), 256).alias("key"), F.size("docs").alias("n_docs"))


def _numbers_guard(docs: DataFrame, labels: list[str]) -> DataFrame:
    # Only the numbers go through the shuffle, not the texts.
    rows = docs.select("doc_id", *labels, text.numbers(F.col("text")).alias("numbers"))
    found = traffic.previous(rows, labels, ["doc_id"], "numbers", "before").where("before is not null")
    return found.select("doc_id", F.size("numbers").alias("n_numbers"), (F.col("numbers") == F.col("before")).alias("same"))


def numbers_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each document against those of the one before in its source and language."""
    return _numbers_guard(table(spark, sf_dir, "documents"), ["source", "lang"])


def numbers_guard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the one before in its source, whatever the language."""
    return _numbers_guard(table(spark, sf_dir, "documents"), ["source"])


def negation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark, sf_dir).where("before is not null")
    # Every third text gains a negation, so that both outcomes occur.
    new = F.when(F.col("conv_id") % 3 == 0, F.concat(F.col("text"), F.lit(" is not and isn't"))).otherwise(F.col("text"))
    return said.select("conv_id", "turn", F.size(text.negations(new)).alias("n_negations"), text.negation_match(new, F.col("before")).alias("same"))


def query_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark, sf_dir).where("before is not null")
    return said.select("conv_id", "turn", F.bround(text.jaccard(F.col("text"), F.col("before")), 4).alias("similarity"))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", THETA)
    return found.select("a", "b", F.bround("cos", 6).alias("cos"))


def knn_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.knn(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", "label", cache.KNN)
    return found.select("a", "b", F.bround("cos", 6).alias("cos"), "rank")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs and rows are within each threshold: pairs are scored once for all of them."""
    pairs = similar_pairs(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, GRID)))).where("cos >= threshold")
    return pairs.groupBy("threshold").agg(F.count("*").alias("n_pairs"), F.countDistinct("b").alias("n_rows"), F.bround(F.avg("cos"), 4).alias("mean_cos"))


def compared(rows: DataFrame) -> DataFrame:
    """Earlier rows within the threshold, with what stops them in each guard mode; pairs are scored once for all."""
    pairs = vectors.similar_pairs(rows, "seq", "embedding", "label", THETA)
    told = scratch.stage(rows.select("seq", text.guard_signs(F.col("query")).alias("signs"), "lang"), "signs")
    both = pairs.join(told.toDF("a", "cached", "cached_lang"), "a").join(told.toDF("b", "new", "new_lang"), "b")
    covered = cache.context_covers(F.array("cached_lang"), F.array("new_lang"))
    reasons = [cache.reject_reason(F.col("new"), F.col("cached"), c, g).alias(m) for m, c, g in (("cosine", F.lit(True), []), ("context", covered, []), ("guards", covered, cache.GUARDS))]
    return scratch.stage(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.bround("cos", 6).alias("cos"), *reasons), "compared")


#: What must be equal for a candidate to pass, by mode.
SIGNS = {"cosine": (), "context": ("context",), "guards": ("context", "numbers", "negation")}


def _guarded(query: Column) -> list[Column]:
    signs = text.guard_signs(query)
    return [signs["numbers"].alias("numbers"), signs["negations"].alias("negation")]


def signed(rows: DataFrame, *others: str) -> DataFrame:
    """Requests with what guards compare of them, in place of their texts, and other columns."""
    return rows.select("seq", F.col("label").alias("grp"), F.col("embedding").alias("v"), F.col("lang").alias("context"), *_guarded(F.col("query")), *others)


def signed_requests(spark: SparkSession, sf_dir: str, *others: Column) -> DataFrame:
    """The same of all documents, with other columns of them; texts stay where they are read."""
    rows = requests(spark, sf_dir, *_guarded(F.col("text")), *others)
    return rows.withColumnsRenamed({"label": "grp", "embedding": "v", "lang": "context"})


def semantic_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replays.signed_replay(signed_requests(spark, sf_dir), {"guards": SIGNS["guards"]}, [THETA]).drop("mode", "threshold")


def semantic_modes(spark: SparkSession, sf_dir: str, modes: Sequence[str] = MODES) -> DataFrame:
    """A summary per guard mode of both caches of each tenant, the exact one asked first: outcomes, and what stopped the rest.
    What is served writes to neither. A tenant's documents of one cluster have one answer; all but the first expect a hit."""
    opening = F.sha2(F.to_json(F.struct("source", "lang", F.left(F.col("text"), F.lit(CLUSTER_CHARS)).alias("text"))), 256)
    key = cache.cache_key(F.col("text"), F.lit(None).cast("string"), F.array(F.col("lang")))
    rows = scratch.stage(signed_requests(spark, sf_dir, key.alias("key"), opening.alias("cluster"), text.approx_tokens(F.col("text")).alias("tokens")), "asked")
    first = rows.groupBy("grp", "cluster").agg(F.min("seq").alias("answer"))
    named = rows.alias("r").join(first.alias("f"), F.col("r.grp").eqNullSafe(F.col("f.grp")) & (F.col("r.cluster") == F.col("f.cluster")))
    named = scratch.stage(named.select("r.*", "f.answer").drop("cluster"), "answers")
    found = replays.signed_replay(named, {mode: SIGNS[mode] for mode in modes}, [THETA], ["answer", "tokens"], exact="key")
    told = found.join(named.select(F.col("seq").alias("served_from"), F.col("answer").alias("cached_answer")), "served_from", "left")
    told = told.withColumn("outcome", cache.semantic_outcome(F.col("hit"), F.col("answer") == F.col("cached_answer"), F.col("answer") < F.col("seq")))
    return told.groupBy("mode").agg(
        F.count("*").alias("queries"),
        F.count_if("hit").alias("hits"),
        F.count_if(F.col("hit") & (F.col("cosine") == float("inf"))).alias("exact_hits"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("correct_hit", "wrong_hit", "missed_hit", "true_miss")),
        *(F.count_if(F.col("miss_reason") == r).alias(f"stopped_by_{r}") for r in ("context_mismatch", "numbers_mismatch", "negation_mismatch", "low_cosine", "empty")),
        F.sum(F.when(F.col("outcome") == "correct_hit", F.col("tokens")).otherwise(0)).alias("tokens_saved"),
    )


def guarded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits of the guarded semantic cache alone are right, where requests with the same rest by 7 have one answer."""
    hits = semantic_replay(spark, sf_dir).where("hit")
    good = F.col("seq") % 7 == F.col("served_from") % 7
    return hits.agg(F.count_if(~good).alias("wrong_hit"), F.count_if(good).alias("correct_hit"))


def semantic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes under all thresholds. Exact repeats are served by the exact cache and never reach the semantic one; of the
    other requests every fourth is a paraphrase, every fourth a trap; requests with the same rest by 7 have one answer."""
    key, tokens = F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("key"), text.approx_tokens(F.col("text")).alias("tokens")
    rows = scratch.stage(signed_requests(spark, sf_dir, key, tokens), "asked")
    exact = scratch.stage(cache.exact_replay(rows.select("seq", "key", "tokens"), "key", "seq").drop("key"), "exact")
    asked = rows.join(exact.where("not hit").select("seq"), "seq", "left_semi")
    near = replays.signed_replay(asked, SIGNS, GRID, ["tokens"])
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, MODES))).alias("mode")).withColumn("threshold", F.explode(F.array(*map(F.lit, GRID))))
    columns = ["mode", "threshold", "seq", "layer", "served_from", "miss_reason", "tokens"]
    repeats = exact.where("hit").join(F.broadcast(grid)).withColumn("layer", F.lit("exact")).withColumn("miss_reason", F.lit(None).cast("string"))
    told = repeats.select(columns).union(near.withColumn("layer", F.when(F.col("hit"), "semantic").otherwise("llm")).select(columns))
    # What a row is expected to be follows from its number: nothing is joined to rows of all modes and thresholds.
    kind = F.col("seq") % 4
    told = told.withColumn("expected_cache", F.when(kind == 1, "semantic_hit").when(kind == 2, "miss").otherwise("cold"))
    told = told.withColumn("variant", F.when(kind == 2, F.array(*map(F.lit, TRAPS))[(F.col("seq") % 6).cast("int")]))
    outcome = cache.semantic_outcome(F.col("layer") != "llm", F.col("seq") % 7 == F.col("served_from") % 7, F.col("expected_cache") == "semantic_hit")
    return cache.sweep_summary(told.withColumn("outcome", outcome), ["mode", "threshold"], TRAPS, REASONS)


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "at", "tenant", "layer")
    found = cache.ttl_replay(rows, ["tenant", "layer"], "at", "event_id", 3600)
    return found.select("event_id", "hit", F.expr("timestampdiff(SECOND, written_at, at)").alias("age"))


def live_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select(F.col("label").cast("int").alias("tenant"), "seq", F.col("embedding").alias("vec"), text.numbers(F.col("query")).alias("numbers"), text.negations(F.col("query")).alias("negations"))
    return cache.live_replay(rows, THETA).select("seq", "tenant", "hit", "served_from", F.bround("cosine", 6).alias("cosine"))


def latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write per tenant and layer, as an upsert leaves it, with its expiry."""
    rows = events(spark, sf_dir).select("tenant", "layer", "event_id", "tokens", F.unix_timestamp("at").alias("at"))
    found = cache.latest_per_key(rows, ["tenant", "layer"], F.struct("at", "event_id"))
    return found.select("tenant", "layer", "event_id", "tokens", (F.col("at") + cache.TTL_SECONDS).alias("expires"))


QUERIES = {f.__name__: f for f in (exact_cache_replay, exact_cache_summary, cache_key_orders, numbers_guard, numbers_guard_all, negation_guard, query_jaccard, similar_pairs, knn_by_tenant, threshold_sweep, semantic_modes, semantic_sweep, ttl_cache, live_cache, latest_entries, semantic_replay)}

_EXACT = f"""out as (
  select doc_id, row_number() over w > 1 as hit, case when row_number() over w > 1 then first_value(doc_id) over w end as served_from, {sql_tokens('text')} as tokens
  from documents window w as (partition by text, lang order by doc_id))"""
_NUMBERS = r"list_sort(list_transform(regexp_extract_all({0}, '[$€£]?[A-Za-z0-9]*\d[A-Za-z0-9.,:/-]*'), lambda x: regexp_replace(x, '[.,:/-]+$', '')))"
_NEGATIONS = r"list_filter(regexp_extract_all(replace(lower({0}), '’', ''''), '[a-z]+(?:''[a-z]+)?'), lambda w: w in ('not','no','never','none','nothing','nobody','nowhere','neither','nor','cannot','without') or w like '%n''t')"
_SURPLUS = "coalesce(list_sum(list_transform(list_distinct({0}), lambda w: greatest(0, len(list_filter({0}, lambda x: x = w)) - len(list_filter({1}, lambda x: x = w))))), 0)"
_NEAR = f"{SQL_REQUESTS}, near as (select a.seq as a, b.seq as b, list_dot_product(a.embedding, b.embedding) as cos, a.query as cached, b.query as new, a.lang as cached_lang, b.lang as new_lang from requests a join requests b on a.label = b.label and a.seq < b.seq where list_dot_product(a.embedding, b.embedding) >= {THETA})"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_PAIRS = f"pairs as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.embedding::double[], b.embedding::double[]) as cos from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_dot_product(a.embedding::double[], b.embedding::double[]) >= {THETA})"


_REASON = {
    "cosine": "null",
    "context": "case when cached_lang <> new_lang then 'context_mismatch' end",
    "guards": f"case when cached_lang <> new_lang then 'context_mismatch' when {_NUMBERS.format('cached')} <> {_NUMBERS.format('new')} then 'numbers_mismatch' when {_SURPLUS.format(_NEGATIONS.format('cached'), _NEGATIONS.format('new'))} <> {_SURPLUS.format(_NEGATIONS.format('new'), _NEGATIONS.format('cached'))} then 'negation_mismatch' end",
}


def _replay_sql(mode: str, name: str) -> str:
    """Common table expressions for one mode; the misses are folded in row order."""
    return f"""
  cand_{name} as (select a as src, b as dst, round_even(cos, 6) as cos, {_REASON[mode]} as reason from near),
  {_fold_sql(name)}"""


def _fold_sql(name: str) -> str:
    """Which of the requests are hits, over the candidates cand_<name>; tenants share none, so each is folded by itself."""
    return f"""
  req_{name} as (select seq, label, row_number() over (order by seq) as n, row_number() over (partition by label order by seq) as k from requests),
  src_{name} as (select r.label, r.k, r.seq, coalesce(list(c.src) filter (where c.src is not null), []) as js from req_{name} r left join (select * from cand_{name} where reason is null) c on c.dst = r.seq group by all),
  fold_{name} as (select label, 0::bigint as k, []::bigint[] as m from (select distinct label from requests) union all
    select f.label, s.k, case when list_has_any(f.m, s.js) then f.m else list_append(f.m, s.seq) end from fold_{name} f join src_{name} s on s.label = f.label and s.k = f.k + 1),
  miss_{name} as (select unnest(m) as seq from (select label, arg_max(m, k) as m from fold_{name} group by label)),
  told_{name} as (select c.*, c.src in (select seq from miss_{name}) as entry from cand_{name} c),
  best_{name} as (select dst, arg_max(src, (cos, -src)) filter (where reason is null) as src, max(cos) filter (where reason is null) as cos, max(cos) as close, arg_max(coalesce(reason, ''), (cos, -src)) as why from told_{name} where entry group by 1),
  out_{name} as (select r.seq, m.seq is null as hit, case when m.seq is null then b.src end as served_from, case when m.seq is null then b.cos else b.close end as cosine,
    case when m.seq is not null then case when r.n = 1 then 'empty' else coalesce(b.why, 'low_cosine') end end as miss_reason
    from req_{name} r left join miss_{name} m on m.seq = r.seq left join best_{name} b on b.dst = r.seq)"""


#: The folds of all modes and thresholds together; tenants share no entries, so each is folded by itself.
_SWEEP = f"""with recursive {_NEAR},
  once as (select *, min(seq) over (partition by query, lang) as leader from requests),
  asked as (select seq, label, row_number() over (partition by label order by seq) as n from once where seq = leader),
  grid as (select m.mode, t.threshold from (select unnest({list(MODES)}) as mode) m cross join (select unnest({list(GRID)}::double[]) as threshold) t),
  cand as (select near.a as src, near.b as dst, x.label, round_even(cos, 6) as cos, {_REASON['context']} as context, {_REASON['guards']} as guards
    from near join asked x on x.seq = a join asked y on y.seq = b),
  each as (select mode, threshold, label, src, dst, cos, case mode when 'context' then context when 'guards' then guards end as reason from cand join grid on cos >= threshold),
  srcs as (select g.mode, g.threshold, a.label, a.n, a.seq, coalesce(list(c.src) filter (where c.src is not null), []) as js
    from asked a cross join grid g left join (select * from each where reason is null) c on c.dst = a.seq and c.mode = g.mode and c.threshold = g.threshold group by all),
  fold as (select mode, threshold, label, 0::bigint as n, []::bigint[] as m from grid, (select distinct label from asked) union all
    select f.mode, f.threshold, f.label, s.n, case when list_has_any(f.m, s.js) then f.m else list_append(f.m, s.seq) end
    from fold f join srcs s on s.mode = f.mode and s.threshold = f.threshold and s.label = f.label and s.n = f.n + 1),
  miss as (select mode, threshold, unnest(m) as seq from (select mode, threshold, label, arg_max(m, n) as m from fold group by all)),
  seen as (select c.* from each c join miss m on m.mode = c.mode and m.threshold = c.threshold and m.seq = c.src),
  best as (select mode, threshold, dst, arg_max(src, (cos, -src)) filter (reason is null) as src, arg_max(coalesce(reason, ''), (cos, -src)) as why from seen group by all),
  out as (select g.mode, g.threshold, a.seq, m.seq is null as hit, case when m.seq is null then b.src end as served_from,
      case when m.seq is not null then case when a.seq = (select min(seq) from asked) then 'empty' else coalesce(b.why, 'low_cosine') end end as miss_reason
    from asked a cross join grid g left join miss m on m.mode = g.mode and m.threshold = g.threshold and m.seq = a.seq left join best b on b.mode = g.mode and b.threshold = g.threshold and b.dst = a.seq),
  told as (select mode, threshold, seq, 'exact' as layer, leader as served_from, null::varchar as miss_reason from once cross join grid where seq > leader
    union all select mode, threshold, seq, case when hit then 'semantic' else 'llm' end, served_from, miss_reason from out),
  named as (select t.*, case t.seq % 4 when 1 then 'semantic_hit' when 2 then 'miss' else 'cold' end as expected, case when t.seq % 4 = 2 then {list(TRAPS)}[t.seq % 6 + 1] end as variant,
      layer <> 'llm' and t.seq % 7 = served_from % 7 as good, layer <> 'llm' and t.seq % 7 <> served_from % 7 as bad, {sql_tokens('query')} as tokens from told t join requests using (seq))
  select mode, threshold, count(*) as queries, count(*) filter (layer = 'exact') as exact_hits, count(*) filter (layer = 'semantic') as semantic_hits,
    count(*) filter (expected = 'semantic_hit' and good) as paraphrases_caught, count(*) filter (expected = 'semantic_hit') as paraphrases_total,
    round_even(count(*) filter (expected = 'semantic_hit' and good) / nullif(count(*) filter (expected = 'semantic_hit'), 0), 4) as paraphrase_recall,
    count(*) filter (bad) as wrong_hits, count(*) filter (bad and expected = 'miss') as wrong_hits_on_traps, count(*) filter (expected = 'miss') as traps_total, count(*) filter (bad and expected = 'cold') as wrong_hits_on_cold,
    {', '.join(f"count(*) filter (bad and variant = '{v}') as wrong_{v}" for v in TRAPS)},
    {', '.join(f"count(*) filter (expected = 'miss' and miss_reason = '{r}') as traps_stopped_by_{r}" for r in REASONS)},
    {', '.join(f"count(*) filter (expected = 'semantic_hit' and miss_reason = '{r}') as paraphrases_blocked_by_{r}" for r in REASONS)},
    count(*) filter (expected = 'semantic_hit' and layer = 'llm') as missed_hits, sum(case when good then tokens else 0 end)::bigint as tokens_saved,
    round_even(sum(case when good then tokens else 0 end) / nullif(sum(tokens), 0), 4) as tokens_saved_pct from named group by 1, 2"""

#: Both caches in a mode: a row of the same tenant, text and language is a candidate at an infinite cosine.
_COPIES = f"""copies as (select a.seq as src, b.seq as dst from requests a join requests b on a.label is not distinct from b.label and a.query is not distinct from b.query and a.lang is not distinct from b.lang and a.seq < b.seq),
  answers as (select seq, min(seq) over (partition by label, source, lang, left(query, {CLUSTER_CHARS})) as answer, {sql_tokens('query')} as tokens from (select r.*, d.source from requests r join documents d on d.doc_id = r.seq))"""


def _layers_sql(mode: str) -> str:
    return f"""
  cand_{mode} as (select a as src, b as dst, round_even(cos, 6) as cos, {_REASON[mode]} as reason from near union all select src, dst, 'infinity'::double, null from copies),
  {_fold_sql(mode)}"""


_LAYERS = """select '{0}' as mode, count(*) as queries, count(*) filter (hit) as hits, count(*) filter (hit and cosine = 'infinity'::double) as exact_hits,
  count(*) filter (hit and x.answer = y.answer) as correct_hit, count(*) filter (hit and x.answer <> y.answer) as wrong_hit,
  count(*) filter (not hit and x.answer < o.seq) as missed_hit, count(*) filter (not hit and x.answer = o.seq) as true_miss,
  count(*) filter (miss_reason = 'context_mismatch') as stopped_by_context_mismatch, count(*) filter (miss_reason = 'numbers_mismatch') as stopped_by_numbers_mismatch,
  count(*) filter (miss_reason = 'negation_mismatch') as stopped_by_negation_mismatch, count(*) filter (miss_reason = 'low_cosine') as stopped_by_low_cosine, count(*) filter (miss_reason = 'empty') as stopped_by_empty,
  sum(case when hit and x.answer = y.answer then x.tokens else 0 end)::bigint as tokens_saved
  from out_{0} o join answers x on x.seq = o.seq left join answers y on y.seq = o.served_from"""

_MODE = f"""select '{{0}}' as mode, count(*) as queries, count(*) filter (hit) as hits,
  count(*) filter (hit and o.seq % 7 = served_from % 7) as correct_hit, count(*) filter (hit and o.seq % 7 <> served_from % 7) as wrong_hit,
  count(*) filter (not hit and o.seq % 2 = 0) as missed_hit, count(*) filter (not hit and o.seq % 2 <> 0) as true_miss,
  count(*) filter (miss_reason = 'context_mismatch') as stopped_by_context_mismatch, count(*) filter (miss_reason = 'numbers_mismatch') as stopped_by_numbers_mismatch,
  count(*) filter (miss_reason = 'negation_mismatch') as stopped_by_negation_mismatch, count(*) filter (miss_reason = 'low_cosine') as stopped_by_low_cosine, count(*) filter (miss_reason = 'empty') as stopped_by_empty,
  sum(case when hit and o.seq % 7 = served_from % 7 then {sql_tokens('text')} else 0 end)::bigint as tokens_saved
  from out_{{0}} o join documents on doc_id = o.seq"""

#: The semantic cache alone in each mode, with answers by number.
HITS_SQL = f"with recursive {_NEAR}, {_replay_sql('cosine', 'cosine')}, {_replay_sql('context', 'context')}, {_replay_sql('guards', 'guards')} {' union all '.join(_MODE.format(m) for m in ('cosine', 'context', 'guards'))}"

ORACLE_SQL = {
    "exact_cache_replay": f"with {_EXACT} select doc_id, hit, served_from, case when hit then tokens else 0 end as tokens_saved, tokens from out",
    "exact_cache_summary": f"""with {_EXACT}, e as (select doc_id, row_number() over w > 1 as expected, first_value(doc_id) over w as source_doc from documents window w as (partition by source, lang, left(text, {CLUSTER_CHARS}) order by doc_id)),
        o as (select *, case when hit and expected and served_from = source_doc then 'true_hit' when hit and expected then 'wrong_source' when hit then 'false_hit' when expected then 'missed_hit' else 'true_miss' end as outcome from out join e using (doc_id)),
        t as (select count(*) as queries, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, {', '.join(f"count(*) filter (outcome = '{x}') as {x}" for x in ('true_hit', 'false_hit', 'wrong_source', 'missed_hit', 'true_miss'))},
          count(*) filter (expected) as due, sum(tokens)::bigint as context_tokens_total, sum(case when hit then tokens else 0 end)::bigint as context_tokens_saved from o)
        select * exclude (due), round_even(true_hit / nullif(due, 0), 4) as recall, round_even(true_hit / nullif(hits, 0), 4) as precision, round_even(hits / queries, 4) as hit_rate,
          round_even(context_tokens_saved / context_tokens_total, 4) as tokens_saved_pct from t""",
    "cache_key_orders": """with p as (select l_orderkey, list_sort(list(sha256(l_partkey::varchar))) as docs from lineitem group by 1)
        select o_orderkey, sha256(concat_ws('|', o_orderpriority, o_orderstatus, array_to_string(docs, ','))) as key, len(docs)::int as n_docs from orders join p on l_orderkey = o_orderkey""",
    "numbers_guard": f"""with d as (select *, lag(text) over (partition by source, lang order by doc_id) as before from documents)
        select doc_id, len({_NUMBERS.format('text')})::int as n_numbers, {_NUMBERS.format('text')} = {_NUMBERS.format('before')} as same from d where before is not null""",
    "numbers_guard_all": f"""with d as (select *, lag(text) over (partition by source order by doc_id) as before from documents)
        select doc_id, len({_NUMBERS.format('text')})::int as n_numbers, {_NUMBERS.format('text')} = {_NUMBERS.format('before')} as same from d where before is not null""",
    "negation_guard": f"""with {SQL_TURNS}, t as (select conv_id, turn, case when conv_id % 3 = 0 then text || ' is not and isn''t' else text end as new, before from said where before is not null),
        n as (select conv_id, turn, {_NEGATIONS.format('new')} as x, {_NEGATIONS.format('before')} as y from t)
        select conv_id, turn, len(x)::int as n_negations, {_SURPLUS.format('x', 'y')} = {_SURPLUS.format('y', 'x')} as same from n""",
    "query_jaccard": f"""with {SQL_TURNS}, w as (select conv_id, turn, {_WORDS.format('text')} as x, {_WORDS.format('before')} as y from said where before is not null)
        select conv_id, turn, case when len(x) = 0 or len(y) = 0 then 0 else round_even(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 4) end as similarity from w""",
    "similar_pairs": f"with {_PAIRS} select a, b, round_even(cos, 6) as cos from pairs",
    "knn_by_tenant": f"""with p as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.embedding::double[], b.embedding::double[]) as cos from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by a order by cos desc, b)::int as rank from p) select a, b, round_even(cos, 6) as cos, rank from r where rank <= {cache.KNN}""",
    "threshold_sweep": f"""with {_PAIRS}, g(threshold) as (values {', '.join(f'({t}::double)' for t in GRID)})
        select threshold, count(*) as n_pairs, count(distinct b) as n_rows, round_even(avg(round_even(cos, 6)), 4) as mean_cos from pairs join g on round_even(cos, 6) >= threshold group by 1""",
    "semantic_replay": f"with recursive {_NEAR}, {_replay_sql('guards', 'guards')} select * from out_guards",
    "semantic_modes": f"with recursive {_NEAR}, {_COPIES}, {', '.join(map(_layers_sql, MODES))} {' union all '.join(map(_LAYERS.format, MODES))}",
    "live_cache": f"""with recursive {_NEAR},
        cd as (select b as dst, a as src, round_even(cos, 6) as cos, {_NUMBERS.format('cached')} = {_NUMBERS.format('new')} and {_NEGATIONS.format('cached')} = {_NEGATIONS.format('new')} as passes from near),
        rq as (select seq, label::int as tenant, row_number() over (order by seq) as n from requests),
        sr as (select r.n, r.seq, coalesce(list({{'src': c.src, 'cos': c.cos, 'passes': c.passes}} order by c.cos desc, c.src) filter (c.src is not null), []) as cs from rq r left join cd c on c.dst = r.seq group by 1, 2),
        fo as (select 0::bigint as n, []::bigint[] as m union all
          select f.n + 1, case when len(list_filter(list_filter(s.cs, lambda c: list_contains(f.m, c.src))[1:{cache.KNN}], lambda c: c.passes)) > 0 then f.m else list_append(f.m, s.seq) end from fo f join sr s on s.n = f.n + 1),
        mi as (select m from fo order by n desc limit 1),
        seen as (select s.seq, list_filter(s.cs, lambda c: list_contains(mi.m, c.src)) as es, list_contains(mi.m, s.seq) as miss from sr s, mi),
        best as (select seq, not miss as hit, list_filter(es[1:{cache.KNN}], lambda c: c.passes)[1] as served, es[1] as close from seen)
        select b.seq, tenant, hit, case when hit then served.src end as served_from, case when hit then served.cos else close.cos end as cosine from best b join rq using (seq)""",
    "semantic_sweep": _SWEEP,
    "ttl_cache": f"""with recursive {SQL_EVENTS}, o as (select event_id, moment, tenant, layer, row_number() over (partition by tenant, layer order by moment, event_id) as n from ev),
        f as (select event_id, tenant, layer, n, moment, false as hit, moment as written from o where n = 1 union all
          select o.event_id, o.tenant, o.layer, o.n, o.moment, o.moment - f.written < interval 3600 second, case when o.moment - f.written < interval 3600 second then f.written else o.moment end
          from f join o on o.tenant = f.tenant and o.layer = f.layer and o.n = f.n + 1)
        select event_id, hit, floor(epoch(moment - written))::bigint as age from f""",
    "latest_entries": f"with {SQL_EVENTS} select tenant, layer, arg_max(event_id, (floor(epoch(moment)), event_id)) as event_id, arg_max(tokens, (floor(epoch(moment)), event_id)) as tokens, max(floor(epoch(moment)))::bigint + 604800 as expires from ev group by 1, 2",
}
