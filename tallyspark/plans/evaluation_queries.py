"""Queries over evaluations: window configurations on train and test clusters, cost against quality, labelled pairs, and
the router's out-of-fold probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import text, vectors
from tallyspark.operators import cache, checks, context, evaluation, models, routing, traffic
from tallyspark.plans import cache_queries, check_queries
from tallyspark.plans.context_queries import stripped_chunks
from tallyspark.plans.routing_queries import router_rows
from tallyspark.plans.tables import SQL_SCORED, SQL_STRIPPED, chunks, numbered, scored, sections, sql_sentences, sql_tokens, table
from tallyspark.plans.traffic_queries import sql_dollars

#: The third document of each request's ten is the one that answers it; its facts are the beginnings of its first lines.
GOLD, FACTS, FACT_WORDS = 2, 3, 4
#: What the semantic cache's judge costs in all, in dollars.
JUDGE_COST = 0.0123
#: Pipelines of the cost summary: name and window configuration.
PIPELINES = {"section_800": "section_first(budget=800)", "hybrid_800": "hybrid(max,budget=800)", "hybrid_1200": "hybrid(max,budget=1200)", "near_docs": "doc_first(max,gap=0.1)"}
SEEDS = 5


def _holds(facts: str, body: str):
    return F.transform(F.filter(facts, lambda f: F.contains(F.lower(F.col(body)), f.fact)), lambda f: f.k)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_id, gold_doc, facts: array of (k, fact)): the beginnings of the first lines of each request's gold document."""
    rows = sections(spark, sf_dir).withColumn("req_id", F.floor(F.col("doc_id") / 10).cast("long"))
    own = rows.where((F.col("doc_id") % 10 == GOLD) & (F.col("section") != context.REMINDER_SECTION)).withColumn("w", F.split("body", " ")).where(F.size("w") >= FACT_WORDS)
    facts = own.select("req_id", "doc_id", "section_pos", F.lower(F.array_join(F.slice("w", 1, FACT_WORDS), " ")).alias("fact"))
    facts = facts.withColumn("k", F.row_number().over(Window.partitionBy("req_id").orderBy("section_pos"))).where(F.col("k") <= FACTS)
    return facts.groupBy("req_id").agg(F.min("doc_id").alias("gold_doc"), F.collect_list(F.struct("k", "fact")).alias("facts"))


def _clusters(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    """Requests whose gold documents have one source are a cluster."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gold_doc"), F.col("source").alias("cluster_id"))
    return facts.join(sources, "gold_doc").select("req_id", "cluster_id", F.col("gold_doc").cast("long").alias("gold_doc"), F.size("facts").alias("n_facts"))


def _results(spark: SparkSession, sf_dir: str, configs: list[evaluation.Config] = evaluation.WINDOWS) -> DataFrame:
    """What each window configuration keeps of each large request."""
    facts = scratch.stage(_facts(spark, sf_dir), "facts")
    gold = _clusters(spark, sf_dir, facts)
    rows = chunks(spark, sf_dir)
    places = context.repeated_places(rows, context.boilerplate_hashes(sections(spark, sf_dir)), ["req_id", "pos"])
    # What is known of a request's sections comes to them as one row, so that texts move once, to their request.
    at = places.groupBy("req_id", "pos").agg(F.collect_list("i").alias("at")).groupBy("req_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "at"))).alias("repeated"))
    told = scored(spark, sf_dir, rows).join(facts.select("req_id", "facts"), "req_id").join(at, "req_id", "left")
    told = told.withColumn("bare_body", context.bared(F.col("body"), F.col("repeated")[F.col("pos")]))
    told = told.select("req_id", "doc_id", "pos", "section", "tokens", "score", _holds("facts", "body").alias("holds"), text.approx_tokens(F.col("bare_body")).alias("bare_tokens"), _holds("facts", "bare_body").alias("bare_holds"))
    return evaluation.window_results(told, gold, configs)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = scratch.stage(_results(spark, sf_dir), "window-results")
    return evaluation.score_windows(results, evaluation.splits(results, SEEDS))


def window_split_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).drop("place")


def window_split_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chosen_windows(scratch.stage(_scores(spark, sf_dir), "window-scores"))


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all prunings of hybrid windows; a sentence's vector is picked from all ``embeddings`` by its place."""
    rows = scratch.stage(scored(spark, sf_dir), "scored")
    bare = scratch.stage(stripped_chunks(spark, sf_dir).select("req_id", "pos", "body", "tokens"), "bare")
    facts = scratch.stage(_facts(spark, sf_dir), "facts")
    large = rows.groupBy("req_id").agg(F.sum("tokens").alias("original")).where(F.col("original") >= context.LEAST_TOKENS)
    large = scratch.stage(large.join(_clusters(spark, sf_dir, facts), "req_id"), "large-requests")
    asked = rows.join(large.select("req_id"), "req_id", "left_semi")
    kept = None
    for budget in evaluation.WINDOW_BUDGETS:
        part = context.hybrid(asked, bare.select("req_id", "pos", "tokens"), budget=budget).select("req_id", F.lit(budget).alias("budget"), F.explode("kept").alias("pos"))
        kept = part if kept is None else kept.union(part)
    windows = scratch.stage(kept.join(bare, ["req_id", "pos"]).join(rows.select("req_id", "pos", "doc_id"), ["req_id", "pos"]), "pruning-windows")
    vecs, n = numbered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    each = windows.select("req_id", "budget", "pos", "doc_id", F.posexplode(text.sentences(F.col("body"))).alias("i", "sentence"))
    each = each.withColumn("sv", F.pmod(F.col("doc_id") * 31 + F.col("pos") * 17 + F.col("i") * 7, F.lit(n))).withColumn("qv", F.pmod("req_id", F.lit(n)))
    # Each pair of vectors is scored once, and only scores meet the sentences.
    pairs = each.select("sv", "qv").distinct().join(vecs.select(F.col("place").alias("sv"), F.col("embedding").alias("se")), "sv").join(vecs.select(F.col("place").alias("qv"), F.col("embedding").alias("qe")), "qv")
    scores = pairs.select("sv", "qv", F.bround(vectors.dot(F.col("se"), F.col("qe")), 6).alias("score"))
    sentences = each.join(scores, ["sv", "qv"]).select("req_id", "budget", "pos", "i", "sentence", "score")
    found = evaluation.pruned_results(windows.select("req_id", "budget", "pos", "body", "tokens"), sentences, facts.select("req_id", "facts"))
    results = scratch.stage(found.join(large.select("req_id", "cluster_id", "original"), "req_id"), "pruning-results")
    return evaluation.score_prunings(results, evaluation.splits(results, SEEDS))


def pruning_split_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir).drop("place")


def pruning_split_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chosen_prunings(scratch.stage(_pruned(spark, sf_dir), "pruning-scores"))


def fact_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each budget of section-first windows keeps; requests with English gold documents count as easy."""
    langs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("req_id"), "doc_id", F.when(F.col("lang") == "en", "easy").otherwise("complex").alias("difficulty"))
    levels = langs.where(F.col("doc_id") % 10 == GOLD).select("req_id", "difficulty")
    return evaluation.sweep_budgets(_results(spark, sf_dir, evaluation.BUDGETS).join(levels, "req_id"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pipeline, req_id, layer, model, cost_usd, verdict, score, input_tokens): a request is graded by the facts that its
    window keeps; a later request of the same cluster is served from the first, with its grade."""
    # The first configuration stands for the request itself.
    configs = [c for i, c in enumerate(evaluation.WINDOWS) if not i or c.name in PIPELINES.values()]
    results = scratch.stage(_results(spark, sf_dir, configs), "window-results")
    windows = spark.createDataFrame(list(PIPELINES.items()), "pipeline string, config string")
    variants = results.join(F.broadcast(windows), "config").select("pipeline", "req_id", "cluster_id", "all_facts", "gold_kept", "docs_kept", "after")
    whole = results.where(F.col("place") == 0).select(F.lit("baseline").alias("pipeline"), "req_id", "cluster_id", F.lit(True).alias("all_facts"), F.lit(True).alias("gold_kept"), F.lit(10).alias("docs_kept"), F.col("before").alias("after"))
    replay = cache.exact_replay(results.where(F.col("place") == 0).select("req_id", F.col("cluster_id").alias("key")), "key", "req_id").select("req_id", "hit", "served_from")
    verdict = F.when(F.col("all_facts"), "correct").when(F.col("gold_kept"), "partial").otherwise("wrong")
    score = F.when(F.col("all_facts"), "1").when(F.col("gold_kept"), "0.5").otherwise("none")
    each = whole.union(variants).withColumn("verdict", verdict).withColumn("score", score)
    model = F.when(F.col("pipeline") == "baseline", routing.LARGE).otherwise(F.when(F.col("docs_kept") > 1, routing.LARGE).otherwise(routing.SMALL))
    each = each.withColumn("model", model).join(replay, "req_id").withColumn("hit", F.col("hit") & (F.col("pipeline") != "baseline"))
    asked = each.where("not hit").select("pipeline", "req_id", F.lit("llm").alias("layer"), "model", traffic.billed(F.col("model"), F.col("after"), F.lit(120)).alias("cost_usd"), "verdict", "score", F.col("after").alias("input_tokens"))
    source = each.select("pipeline", F.col("req_id").alias("served_from"), F.col("verdict").alias("v"), F.col("score").alias("s"))
    served = each.where("hit").join(source, ["pipeline", "served_from"])
    served = served.select("pipeline", "req_id", F.lit("exact_cache").alias("layer"), F.lit(None).cast("string").alias("model"), F.lit(0.0).alias("cost_usd"), F.col("v").alias("verdict"), F.col("s").alias("score"), F.lit(0).cast("long").alias("input_tokens"))
    return asked.union(served)


def cost_vs_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cost_summary(_answers(spark, sf_dir), JUDGE_COST)


def quality_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.layer_summary(_answers(spark, sf_dir))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clustered queries: each paraphrase with the row that it repeats, each trap with the one before it."""
    rows = check_queries.cluster_expansion(spark, sf_dir)
    ident = lambda i: F.concat_ws(":", F.col("cluster_id").cast("string"), i.cast("string"))
    confusable = F.when((F.col("variant") == "tricky") & (F.col("local_index") > 0), ident(F.col("local_index") - 1))
    told = rows.select(ident(F.col("local_index")).alias("id"), "query", "expected_cache", F.when(F.col("semantic_of").isNotNull(), ident(F.col("semantic_of"))).alias("semantic_of"), confusable.alias("confusable_with"))
    return evaluation.labelled_pairs(told)


#: What each layer must keep to: metric, kind of bound, value.
GATES = [("false_hit", "max", 0), ("wrong_hit", "max", 400), ("correct_hit", "min", 1), ("all_facts_kept", "min", 0.25), ("avg_tokens_after", "max", 800)]


def layer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the exact cache, the guarded semantic cache and the window of 800 tokens."""
    exact = cache_queries.exact_cache_summary(spark, sf_dir).select("false_hit")
    semantic = cache_queries.guarded_hits(spark, sf_dir)
    window = fact_sweep(spark, sf_dir).where("config = 'section_first(budget=800)'").select("all_facts_kept", "avg_tokens_after")
    # Each has one row.
    return checks.gates(exact.join(semantic).join(window), GATES)


def offline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a request of the small pipeline, with its offline grade and the baseline's, both from labels: a good
    text counts as correct, a toxic one as wrong; the baseline is wrong about toxic texts only."""
    labels = table(spark, sf_dir, "labels")
    own = F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "partial")
    base = F.when(F.col("toxic") == 1, "wrong").when(F.col("toxic") == 0, "correct")
    grades = labels.select(F.col("doc_id").alias("query_id"), F.inline(F.array(F.struct(F.lit("small").alias("pipeline"), own.alias("grade")), F.struct(F.lit("baseline").alias("pipeline"), base.alias("grade")))))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.lit("small").alias("pipeline"))
    return models.graded(rows, grades).select("query_id", "own_grade", "base_grade", "verdict")


def blind_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pipelines' answers, graded without knowing whose they are: the whole text, its first half and its first words.
    An answer that holds a document's last three words is correct, one that holds the middle ones is partly so."""
    w = F.split("text", " ")
    docs = table(spark, sf_dir, "documents").withColumn("w", w).where(F.size("w") >= 6)
    some = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    half = F.floor(F.size("w") / 2).cast("int")
    answers = docs.select(F.col("doc_id").alias("query_id"), F.inline(F.array(*(F.struct(F.lit(name).alias("pipeline"), answer.alias("answer")) for name, answer in (("whole", F.col("text")), ("half", some(1, half)), ("head", some(1, 3)))))))
    keys = docs.select(F.col("doc_id").alias("query_id"), some(F.size("w") - 2, F.lit(3)).alias("last"), some(half - 2, F.lit(3)).alias("middle"))
    grade = F.when(F.contains("answer", F.col("last")), "correct").when(F.contains("answer", F.col("middle")), "partial").otherwise("wrong")
    found = models.blind_grades(answers, lambda shown: shown.join(keys, "query_id").withColumn("grade", grade), seed=11)
    return found.groupBy("pipeline", "grade").agg(F.count("*").alias("n"))


def router_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document's probability by a router that its source had no part in."""
    rows = router_rows(spark, sf_dir)
    return routing.out_of_fold(rows, "source", "embedding", "needs_large").select("doc_id", "lang", "source", "fold", (F.col("needs_large") == 1).alias("complex"), F.bround("p_large", 3).alias("p_large"))


def router_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per seed five strategies on the test clusters: the router's threshold comes from out-of-fold probabilities of the
    training clusters."""
    rows = router_rows(spark, sf_dir)
    splits = scratch.stage(evaluation.splits(rows.select(F.col("source").alias("cluster_id")), SEEDS).withColumnRenamed("cluster_id", "source"), "splits")

    def compared(seed: int) -> DataFrame:
        mine = F.broadcast(splits.where(F.col("seed") == seed))
        train, test = (scratch.stage(rows.join(mine.where(F.col("split") == s).select("source"), "source"), s) for s in ("train", "test"))
        # The strategies of a seed are a few rows, but their plan goes over the test rows: it runs here, beside the others.
        return scratch.stage(routing.compare_strategies(train, test, "source", "embedding", "needs_large").withColumn("seed", F.lit(seed)), "strategies")

    found = None
    for part in routing.together(spark, [lambda seed=seed: compared(seed) for seed in range(SEEDS)], parallel=SEEDS):
        found = part if found is None else found.union(part)
    return found


QUERIES = {f.__name__: f for f in (window_split_eval, window_split_chosen, pruning_split_eval, pruning_split_chosen, fact_sweep, layer_gates, offline_verdicts, blind_grades, cost_vs_quality, quality_by_layer, labelled_pairs, router_out_of_fold, router_strategies)}

_ADDED = "{'used': a.used + c.used, 'docs': list_distinct(list_concat(a.docs, c.docs)), 'holds': list_distinct(list_concat(a.holds, c.holds))}"
_EMPTY = "{'used': 0::bigint, 'docs': []::bigint[], 'holds': []::int[]}"


def _kept_sql(c: evaluation.Config) -> str:
    if c.approach == "section_first":
        return f"list_reduce(full_, lambda a, c: case when len(a.docs) > 0 and a.used + c.used > {c.budget} then a else {_ADDED} end, {_EMPTY})"
    docs = f"docs_{c.method}"
    if c.approach == "doc_first":
        near = f"list_transform(list_filter({docs}[1:{evaluation.MAX_DOCS}], lambda d: d.minus <= {docs}[1].minus + {c.gap}::double), lambda d: d.doc_id)"
        return f"list_reduce(list_filter(bare, lambda x: list_contains({near}, x.docs[1])), lambda a, c: {_ADDED}, {_EMPTY})"
    top = f"{docs}[1].doc_id"
    whole = f"list_reduce(list_filter(bare, lambda x: x.docs[1] = {top}), lambda a, c: {_ADDED}, {_EMPTY})"
    return f"list_reduce(list_filter(bare, lambda x: x.docs[1] <> {top}), lambda a, c: case when a.used + c.used > {c.budget} then a else {_ADDED} end, {whole})"


_FACTS = f"""{SQL_SCORED}, {SQL_STRIPPED},
  facts as (select * from (select req_id, doc_id, lower(array_to_string(string_split(body, ' ')[1:{FACT_WORDS}], ' ')) as fact, row_number() over (partition by req_id order by pos)::int as k
    from chunks where doc_id % 10 = {GOLD} and section <> 'repeated_reminders' and len(string_split(body, ' ')) >= {FACT_WORDS}) where k <= {FACTS}),
  gold as (select f.req_id, d.source as cluster_id, f.gold_doc, f.n_facts from (select req_id, min(doc_id) as gold_doc, count(*) as n_facts from facts group by 1) f join documents d on d.doc_id = f.gold_doc)"""


def _results_sql(configs: list[evaluation.Config]) -> str:
    return f"""{_FACTS},
  held as (select c.req_id, c.pos, any_value(c.doc_id) as doc_id, any_value(c.section) as section, any_value(c.tokens) as tokens, any_value(c.score) as score, any_value(s.body) as bare,
      coalesce(list(f.k) filter (contains(lower(c.body), f.fact)), []) as holds, coalesce(list(f.k) filter (contains(lower(s.body), f.fact)), []) as bare_holds
    from scored c join facts f on f.req_id = c.req_id left join stripped s on s.req_id = c.req_id and s.pos = c.pos group by 1, 2),
  ds as (select req_id, doc_id, -max(round_even(score * 1e6, 0)::bigint) / 1e6::double as best, -sum(round_even(score * 1e6, 0)::bigint)::bigint / count(*) / 1e6::double as mean, min(pos) as first from held group by 1, 2),
  dd as (select req_id, list({{'minus': best, 'doc_id': doc_id}} order by best, first) as docs_max, list({{'minus': mean, 'doc_id': doc_id}} order by mean, first) as docs_mean from ds group by 1),
  g as (select req_id, sum(tokens)::bigint as before,
      coalesce(list({{'used': tokens::bigint, 'docs': [doc_id], 'holds': holds}} order by score desc, pos) filter (section <> 'repeated_reminders'), []) as full_,
      coalesce(list({{'used': {sql_tokens('bare')}::bigint, 'docs': [doc_id], 'holds': bare_holds}} order by score desc, pos) filter (bare is not null), []) as bare
    from held group by 1 having sum(tokens) >= {context.LEAST_TOKENS}),
  gg as materialized (select * from g join dd using (req_id) join gold using (req_id)),
  kept as ({' union all '.join(f"select req_id, cluster_id, gold_doc, n_facts, before, '{c.approach}' as approach, '{c.name}' as config, {i} as place, {_kept_sql(c)} as k from gg" for i, c in enumerate(configs))}),
  res as materialized (select req_id, cluster_id, approach, config, place, len(k.holds) = n_facts as all_facts, list_contains(k.docs, gold_doc) as gold_kept, len(k.docs) as docs_kept, before, k.used as after from kept)"""


_RESULTS = _results_sql(evaluation.WINDOWS)
_SCORES = f"""{_RESULTS},
  cl as (select cluster_id, seed, row_number() over (partition by seed order by sha256(seed || ':' || cluster_id)) as r, count(*) over (partition by seed) as n from (select distinct cluster_id from res) cross join (select unnest(range({SEEDS}))::int as seed)),
  sp as (select cluster_id, seed, case when r <= n // 2 then 'train' else 'test' end as split from cl),
  sc as (select seed, split, approach, config, place, count(*) as queries, round_even(count(*) filter (all_facts) / count(*), 4) as all_facts_kept, round_even(count(*) filter (gold_kept) / count(*), 4) as gold_docs_kept,
      round_even(sum(docs_kept) / count(*), 4) as mean_docs, round_even(sum(after) / count(*), 4) as mean_tokens, round_even(1 - sum(after) / sum(before), 4) as tokens_saved
    from res join sp using (cluster_id) group by 1, 2, 3, 4, 5)"""
_PIPES = ", ".join(f"('{k}', '{v}')" for k, v in PIPELINES.items())
_ANSWERS = f"""{_RESULTS},
  pipes(pipeline, config) as (values {_PIPES}),
  fst as (select req_id, min(req_id) over (partition by cluster_id) as first from res where place = 0),
  ea as (select 'baseline' as pipeline, req_id, true as all_facts, true as gold_kept, 10 as docs_kept, before as after from res where place = 0
    union all select pipeline, req_id, all_facts, gold_kept, docs_kept, after from res join pipes using (config)),
  ev as (select ea.*, first, req_id > first and pipeline <> 'baseline' as hit, case when all_facts then 'correct' when gold_kept then 'partial' else 'wrong' end as verdict, case when all_facts then '1' when gold_kept then '0.5' else 'none' end as score,
      case when pipeline = 'baseline' or docs_kept > 1 then 'large' else 'small' end as model from ea join fst using (req_id)),
  an as (select pipeline, req_id, 'llm' as layer, model, round_even(after * case model when 'small' then 0.10::double else 2.00::double end + 120 * case model when 'small' then 0.50::double else 10.00::double end, 0) / 1e6::double as cost_usd, verdict, score, after as input_tokens from ev where not hit
    union all select a.pipeline, a.req_id, 'exact_cache', null, 0, b.verdict, b.score, 0 from ev a join ev b on b.pipeline = a.pipeline and b.req_id = a.first where a.hit)"""
_PRUNED_SCORES = rf"""{_FACTS},
  tops as (select req_id, arg_max(doc_id, (s, -first)) as top from (select req_id, doc_id, max(score) as s, min(pos) as first from scored group by 1, 2) group by 1),
  tot as (select req_id, sum(tokens)::bigint as original from scored group by 1 having sum(tokens) >= {context.LEAST_TOKENS}),
  parts as (select c.req_id, t.top, c.doc_id, c.pos, c.score, s.body, {sql_tokens('s.body')} as tokens from scored c join stripped s using (req_id, pos) join tops t using (req_id) join tot using (req_id) join gold using (req_id)),
  grp as (select req_id, coalesce(sum(tokens) filter (doc_id = top), 0)::bigint as whole, coalesce(list(pos) filter (doc_id = top), []) as own,
    coalesce(list({{'used': tokens::bigint, 'kept': [pos]}} order by score desc, pos) filter (doc_id <> top), []) as l from parts group by 1),
  fit as (select req_id, b, own, list_reduce(l, lambda a, c: case when a.used + c.used > b then a else {{'used': a.used + c.used, 'kept': list_concat(a.kept, c.kept)}} end, {{'used': whole, 'kept': []::int[]}}) as r from grp, (select unnest({list(evaluation.WINDOW_BUDGETS)}) as b)),
  win as (select p.req_id, b, p.doc_id, p.pos, p.body, p.tokens from fit f join parts p on p.req_id = f.req_id and (list_contains(f.own, p.pos) or list_contains(f.r.kept, p.pos))),
  sent as (select req_id, b, doc_id, pos, unnest(range(len(ss)))::int as i, unnest(ss) as sentence from (select *, {sql_sentences('body')} as ss from win)),
  said as (select s.*, round_even(list_dot_product(v.embedding::double[], q.embedding::double[]), 6) as score from sent s
    join vecs v on v.place = (s.doc_id * 31 + s.pos * 17 + s.i * 7) % (select count(*) from embeddings) join vecs q on q.place = s.req_id % (select count(*) from embeddings)),
  rk as (select *, row_number() over (partition by req_id, b order by score desc, pos, i) as r, count(*) over (partition by req_id, b) as n, row_number() over (partition by req_id, b, pos order by score desc, i) as f from said),
  cfg(k, nb, config, place) as (values {', '.join(f"({p.ratio}::double, {p.neighbours}, '{p.name}', {i})" for i, p in enumerate(evaluation.PRUNINGS))}),
  m0 as (select *, r <= greatest(1, ceil(k * n)) as k0 from rk, cfg where k < 1),
  m1 as (select *, k0 or (not bool_or(k0) over (partition by req_id, b, place, pos) and f = 1) as k1 from m0),
  m2 as (select *, k1 or nb > 0 and bool_or(k1) over (partition by req_id, b, place, pos order by i rows between 1 preceding and 1 following) as stays from m1),
  bodies as (select req_id, b, place, pos, string_agg(regexp_replace(regexp_replace(sentence, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ' order by i) as kept from m2 where stays group by all),
  pruned as (select w.req_id, w.b, w.pos, w.tokens, c.place, c.config, case when c.k >= 1 then w.body else coalesce(y.kept, '') end as kept from win w cross join cfg c left join bodies y on y.req_id = w.req_id and y.b = w.b and y.pos = w.pos and y.place = c.place),
  hits as (select p.req_id, b, place, count(distinct f.k) as n_held from pruned p join facts f on f.req_id = p.req_id and contains(lower(p.kept), f.fact) group by all),
  pres as (select p.req_id, any_value(g.cluster_id) as cluster_id, any_value(t.original) as original, p.b as budget, p.place, any_value(p.config) as config, coalesce(any_value(h.n_held), 0) = any_value(g.n_facts) as all_facts, sum(p.tokens) as windowed, sum({sql_tokens('p.kept')}) as after
    from pruned p join gold g using (req_id) join tot t using (req_id) left join hits h on h.req_id = p.req_id and h.b = p.b and h.place = p.place group by p.req_id, p.b, p.place),
  cl as (select cluster_id, seed, row_number() over (partition by seed order by sha256(seed || ':' || cluster_id)) as r, count(*) over (partition by seed) as n from (select distinct cluster_id from pres) cross join (select unnest(range({SEEDS}))::int as seed)),
  sp as (select cluster_id, seed, case when r <= n // 2 then 'train' else 'test' end as split from cl),
  sc as (select seed, split, budget, config, place, count(*) as queries, round_even(count(*) filter (all_facts) / count(*), 4) as all_facts_kept, round_even(sum(windowed) / count(*), 0) as avg_tokens_after_window,
      round_even(sum(after) / count(*), 0) as avg_tokens_after_compression, round_even(1 - sum(after) / nullif(sum(windowed), 0), 4) as saved_of_windowed, round_even(1 - sum(after) / nullif(sum(original), 0), 4) as saved_of_original
    from pres join sp using (cluster_id) group by 1, 2, 3, 4, 5)"""
_EXPANSION = check_queries.ORACLE_SQL["cluster_expansion"]

ORACLE_SQL = {
    "window_split_eval": f"with {_SCORES} select * exclude (place) from sc",
    "window_split_chosen": f"""with {_SCORES}, b as (select *, row_number() over (partition by seed, approach order by all_facts_kept desc, mean_tokens, place) as r from sc where split = 'train')
        select b.seed, b.approach, b.config, b.all_facts_kept as train_facts, b.mean_tokens as train_tokens, t.queries as test_queries, t.all_facts_kept as test_facts, t.gold_docs_kept as test_gold_docs, t.mean_tokens as test_tokens, t.tokens_saved as test_saved
        from b left join sc t on t.seed = b.seed and t.config = b.config and t.split = 'test' where r = 1""",
    "fact_sweep": f"""with {_results_sql(evaluation.BUDGETS)}, lv as (select doc_id // 10 as req_id, case when lang = 'en' then 'easy' else 'complex' end as difficulty from documents where doc_id % 10 = {GOLD})
        select config, count(*) as queries, round_even(count(*) filter (gold_kept) / count(*), 4) as gold_docs_kept, round_even(count(*) filter (all_facts) / count(*), 4) as all_facts_kept,
          {', '.join(f"round_even(count(*) filter (all_facts and difficulty = '{d}') / greatest(1, count(*) filter (difficulty = '{d}')), 4) as all_facts_kept_{d}" for d in ('easy', 'complex'))},
          round_even(sum(before) / count(*), 0) as avg_tokens_before, round_even(sum(after) / count(*), 0) as avg_tokens_after, round_even(1 - sum(after) / sum(before), 4) as tokens_saved from res join lv using (req_id) group by 1""",
    "offline_verdicts": """with g as (select doc_id, case when toxic = 1 then 'wrong' when quality = 1 then 'correct' when quality = 0 then 'partial' end as own_grade, case when toxic = 1 then 'wrong' when toxic = 0 then 'correct' end as base_grade from labels)
        select d.doc_id as query_id, own_grade, base_grade, case when own_grade is null or base_grade is null then null when own_grade = base_grade then 'equivalent'
          when list_position(['wrong', 'partial', 'correct'], own_grade) > list_position(['wrong', 'partial', 'correct'], base_grade) then 'better' else 'worse' end as verdict from documents d left join g using (doc_id)""",
    "blind_grades": """with w as (select text, string_split(text, ' ') as w from documents where len(string_split(text, ' ')) >= 6),
        k as (select text, w, array_to_string(w[-3:], ' ') as last, array_to_string(w[len(w) // 2 - 2:len(w) // 2], ' ') as middle from w),
        a as (select last, middle, unnest(['whole', 'half', 'head']) as pipeline, unnest([text, array_to_string(w[1:len(w) // 2], ' '), array_to_string(w[1:3], ' ')]) as answer from k)
        select pipeline, case when contains(answer, last) then 'correct' when contains(answer, middle) then 'partial' else 'wrong' end as grade, count(*) as n from a group by 1, 2""",
    "pruning_split_eval": f"with {_PRUNED_SCORES} select * exclude (place) from sc",
    "pruning_split_chosen": f"""with {_PRUNED_SCORES}, none as (select seed, split, budget, all_facts_kept as without from sc where config = 'none'),
        b as (select s.*, n.without, row_number() over (partition by s.seed, s.budget order by s.avg_tokens_after_compression, s.place) as r from sc s join none n on n.seed = s.seed and n.budget = s.budget and n.split = 'train'
          where s.split = 'train' and s.all_facts_kept >= n.without - {evaluation.MARGIN}::double)
        select b.seed, b.budget, b.config, b.without as train_without, b.all_facts_kept as train_chosen, t.queries as test_queries, t.all_facts_kept as test_chosen, t.avg_tokens_after_compression as test_tokens, t.saved_of_windowed, t.saved_of_original, n.without as test_without
        from b left join sc t on t.seed = b.seed and t.budget = b.budget and t.config = b.config and t.split = 'test' left join none n on n.seed = b.seed and n.budget = b.budget and n.split = 'test' where b.r = 1""",
    "cost_vs_quality": f"""with {_ANSWERS}, t as (select pipeline, count(*) as queries, sum(round_even(cost_usd * 1e6, 0)::bigint)::bigint + case when pipeline = 'baseline' then 0 else {round(JUDGE_COST * 1e6)} end as micros,
          round_even(count(*) filter (verdict = 'correct') / count(*), 4) as correct, round_even(count(*) filter (verdict = 'partial') / count(*), 4) as partial, round_even(count(*) filter (verdict = 'wrong') / count(*), 4) as wrong, count(*) filter (verdict not in ('correct', 'partial', 'wrong')) as unparsed,
          round_even(coalesce(sum(round_even(try_cast(score as double) * 100, 0)::bigint)::bigint, null) / greatest(1, count(try_cast(score as double))) / 100, 3) as mean_score, count(*) filter (layer <> 'llm') as cached, count(*) filter (model = 'small') as small, count(*) filter (model = 'large') as large, sum(input_tokens)::bigint as input_tokens from an group by 1)
        select pipeline, queries, micros / 1e6::double as cost_usd, micros / (queries * 1000::double) as per_1k, micros / nullif((select micros from t where pipeline = 'baseline'), 0) as vs_base, correct, partial, wrong, unparsed, mean_score, cached, small, large, input_tokens from t""",
    "quality_by_layer": f"with {_ANSWERS} select pipeline, layer, coalesce(model, '') as model, count(*) as queries, round_even(count(*) filter (verdict = 'correct') / count(*), 4) as correct, round_even(count(*) filter (verdict = 'wrong') / count(*), 4) as wrong, {sql_dollars('cost_usd')} as cost_usd from an group by 1, 2, 3",
    "labelled_pairs": f"""with x as ({_EXPANSION}), r as (select cluster_id || ':' || local_index as id, query, expected_cache, cluster_id || ':' || semantic_of as semantic_of, case when variant = 'tricky' then cluster_id || ':' || (local_index - 1) end as confusable_with from x),
        p as (select id, query, case when expected_cache = 'semantic_hit' then 'paraphrase' else 'trap' end as kind, case expected_cache when 'semantic_hit' then semantic_of when 'miss' then confusable_with end as other_id from r)
        select p.id, p.kind, p.other_id, p.query, r.query as other_query from p join r on r.id = p.other_id""",
}

ORACLE_SQL["layer_gates"] = f"""with m as (select * from (select false_hit from ({cache_queries.ORACLE_SQL['exact_cache_summary']})), (select wrong_hit, correct_hit from ({cache_queries.HITS_SQL}) where mode = 'guards'),
    (select all_facts_kept, avg_tokens_after from ({ORACLE_SQL['fact_sweep']}) where config = 'section_first(budget=800)'))
    {' union all '.join(f"select '{m}_{k}' as name, {m}::double as value, {v}::double as bound, {m} {'<=' if k == 'max' else '>='} {v} as ok from m" for m, k, v in GATES)}"""
