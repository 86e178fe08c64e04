"""Evaluations over grids of configurations, with configurations chosen on training clusters and judged on others."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import context


class Config(NamedTuple):
    approach: str
    method: str
    budget: int
    gap: float

    @property
    def name(self) -> str:
        told = {"section_first": f"budget={self.budget}", "doc_first": f"{self.method},gap={self.gap:g}", "hybrid": f"{self.method},budget={self.budget}"}
        return f"{self.approach}({told[self.approach]})"


METHODS = ("max", "mean")
#: 5 + 14 + 10 configurations.
WINDOWS = (
    [Config("section_first", "", b, 0.0) for b in range(400, 1201, 200)]
    + [Config("doc_first", m, 0, g) for m in METHODS for g in (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15)]
    + [Config("hybrid", m, b, 0.0) for m in METHODS for b in (600, 700, 800, 1000, 1200)]
)
BUDGETS = [Config("section_first", "", b, 0.0) for b in (100, 200, 300, 400, 500, 600, 800, 1000, 1200)]
MAX_DOCS = 3


def _add(a: Column, c: Column) -> Column:
    return F.struct((a.used + c.tokens).alias("used"), F.array_union(a.docs, F.array(c.doc_id)).alias("docs"), F.array_union(a.holds, c.holds).alias("holds"))


_NOTHING = "named_struct('used', 0L, 'docs', cast(array() as array<bigint>), 'holds', cast(array() as array<int>))"


def _kept(c: Config) -> Column:
    """What a configuration keeps of a request's ordered sections: used tokens, documents, facts."""
    if c.approach == "section_first":
        return F.aggregate("full", F.expr(_NOTHING), lambda a, x: F.when((F.size(a.docs) > 0) & (a.used + x.tokens > c.budget), a).otherwise(_add(a, x)))
    docs = F.col(f"docs_{c.method}")
    if c.approach == "doc_first":
        near = F.transform(F.filter(F.slice(docs, 1, MAX_DOCS), lambda d: d.minus <= docs[0].minus + F.lit(c.gap)), lambda d: d.doc_id)
        return F.aggregate(F.filter("bare", lambda x: F.array_contains(near, x.doc_id)), F.expr(_NOTHING), _add)
    top = docs[0].doc_id
    whole = F.aggregate(F.filter("bare", lambda x: x.doc_id == top), F.expr(_NOTHING), _add)
    return F.aggregate(F.filter("bare", lambda x: x.doc_id != top), whole, lambda a, x: F.when(a.used + x.tokens > c.budget, a).otherwise(_add(a, x)))


def window_results(chunks: DataFrame, gold: DataFrame, configs: list[Config] = WINDOWS, least_tokens: int = context.LEAST_TOKENS) -> DataFrame:
    """(req_id, cluster_id, approach, config, place, all_facts, gold_kept, docs_kept, before, after) of each request that
    is large enough and configuration.

    ``chunks`` has (req_id, doc_id, pos, section, tokens, score, holds, bare_tokens, bare_holds): holds are the numbers
    of the request's facts that a section holds, bare ones those without boilerplate (null tokens if it was dropped).
    ``gold`` has (req_id, cluster_id, gold_doc, n_facts). Sections are ordered once for all configurations; document
    scores are sums of whole millionths, so that the order of rows doesn't matter.
    """
    doc = Window.partitionBy("req_id", "doc_id")
    micros = F.rint(F.col("score") * 1e6).cast("long")
    rows = chunks.withColumn("minus", -F.col("score")).withColumn("first", F.min("pos").over(doc))
    rows = rows.withColumn("best", -F.max(micros).over(doc) / F.lit(1e6)).withColumn("mean", -F.sum(micros).over(doc) / F.count("*").over(doc) / F.lit(1e6))

    def ordered(keep: Column, tokens: str, holds: str) -> Column:
        return F.array_sort(F.collect_list(F.when(keep, F.struct("minus", "pos", F.col(tokens).cast("long").alias("tokens"), F.col("doc_id").cast("long").alias("doc_id"), F.col(holds).alias("holds")))))

    def ranked(score: str) -> Column:
        return F.array_sort(F.collect_set(F.struct(F.col(score).alias("minus"), "first", F.col("doc_id").cast("long").alias("doc_id"))))

    each = rows.groupBy("req_id").agg(
        ordered(F.col("section") != context.REMINDER_SECTION, "tokens", "holds").alias("full"),
        ordered(F.col("bare_tokens").isNotNull(), "bare_tokens", "bare_holds").alias("bare"),
        ranked("best").alias("docs_max"),
        ranked("mean").alias("docs_mean"),
        F.sum("tokens").alias("before"),
    )
    each = each.where(F.col("before") >= least_tokens).join(gold, "req_id")
    told = F.array(*(F.struct(F.lit(c.approach).alias("approach"), F.lit(c.name).alias("config"), F.lit(i).alias("place"), _kept(c).alias("k")) for i, c in enumerate(configs)))
    return each.select("req_id", "cluster_id", "gold_doc", "n_facts", "before", F.inline(told)).select(
        "req_id",
        "cluster_id",
        "approach",
        "config",
        "place",
        (F.size("k.holds") == F.col("n_facts")).alias("all_facts"),
        F.array_contains("k.docs", F.col("gold_doc")).alias("gold_kept"),
        F.size("k.docs").alias("docs_kept"),
        "before",
        F.col("k.used").alias("after"),
    )


def splits(clusters: DataFrame, seeds: int = 5) -> DataFrame:
    """(cluster_id, seed, split): for each seed half of the clusters train and the others test, by a hash of both."""
    each = clusters.select("cluster_id").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    draw = F.sha2(F.concat_ws(":", F.col("seed").cast("string"), "cluster_id"), 256)
    seed = Window.partitionBy("seed")
    ranked = each.withColumn("r", F.row_number().over(seed.orderBy(draw))).withColumn("n", F.count("*").over(seed))
    return ranked.select("cluster_id", "seed", F.when(F.col("r") <= F.floor(F.col("n") / 2), "train").otherwise("test").alias("split"))


def score_windows(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per seed, split and configuration: shares with all facts and with the gold document, means, and what is saved."""
    n = F.count("*")
    return results.join(F.broadcast(clusters), "cluster_id").groupBy("seed", "split", "approach", "config", "place").agg(
        n.alias("queries"),
        F.bround(F.count_if("all_facts") / n, 4).alias("all_facts_kept"),
        F.bround(F.count_if("gold_kept") / n, 4).alias("gold_docs_kept"),
        F.bround(F.sum("docs_kept") / n, 4).alias("mean_docs"),
        F.bround(F.sum("after") / n, 4).alias("mean_tokens"),
        F.bround(1 - F.sum("after") / F.sum("before"), 4).alias("tokens_saved"),
    )


def sweep_budgets(results: DataFrame) -> DataFrame:
    """Per configuration of ``window_results``, joined with a difficulty: what is kept, in all and by difficulty."""
    n = F.count("*")
    share = lambda d: F.bround(F.count_if(F.col("all_facts") & (F.col("difficulty") == d)) / F.greatest(F.lit(1), F.count_if(F.col("difficulty") == d)), 4)
    return results.groupBy("config").agg(
        n.alias("queries"),
        F.bround(F.count_if("gold_kept") / n, 4).alias("gold_docs_kept"),
        F.bround(F.count_if("all_facts") / n, 4).alias("all_facts_kept"),
        *(share(d).alias(f"all_facts_kept_{d}") for d in ("easy", "complex")),
        F.bround(F.sum("before") / n, 0).alias("avg_tokens_before"),
        F.bround(F.sum("after") / n, 0).alias("avg_tokens_after"),
        F.bround(1 - F.sum("after") / F.sum("before"), 4).alias("tokens_saved"),
    )


def chosen_windows(scores: DataFrame) -> DataFrame:
    """Per seed and approach the configuration that is best in training, with its scores on the test clusters."""
    order = Window.partitionBy("seed", "approach").orderBy(F.desc("all_facts_kept"), "mean_tokens", "place")
    best = scores.where("split = 'train'").withColumn("r", F.row_number().over(order)).where("r = 1")
    best = best.select("seed", "approach", "config", F.col("all_facts_kept").alias("train_facts"), F.col("mean_tokens").alias("train_tokens"))
    test = scores.where("split = 'test'").select("seed", "config", F.col("queries").alias("test_queries"), F.col("all_facts_kept").alias("test_facts"), F.col("gold_docs_kept").alias("test_gold_docs"), F.col("mean_tokens").alias("test_tokens"), F.col("tokens_saved").alias("test_saved"))
    return best.join(test, ["seed", "config"], "left")


class Pruning(NamedTuple):
    ratio: float
    neighbours: int

    @property
    def name(self) -> str:
        return "none" if self.ratio >= 1 else f"keep={self.ratio:g},neighbours={self.neighbours}"


#: 13 ways of pruning, under each window budget.
PRUNINGS = [Pruning(1.0, 0)] + [Pruning(k, n) for k in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9) for n in (0, 1)]
WINDOW_BUDGETS = (800, 1200)
#: A pruning may lose this share of the requests that keep all facts without one.
MARGIN = 0.02


def pruned_results(windows: DataFrame, sentences: DataFrame, facts: DataFrame, prunings: list[Pruning] = PRUNINGS) -> DataFrame:
    """(req_id, budget, config, place, all_facts, windowed, after) of each request, window budget and pruning.

    ``windows`` has the sections (req_id, budget, pos, body, tokens) that a window kept, ``sentences`` their sentences
    (req_id, budget, pos, i, sentence, score), ``facts`` (req_id, facts: array of (k, fact)), in lower case.

    Sentences are ranked once for all prunings. The best one of a section always stays and gets rank 0; a share of a
    request's sentences is a rank that others must reach, and with neighbours the least rank next to one counts.
    """
    request, section = Window.partitionBy("req_id", "budget"), Window.partitionBy("req_id", "budget", "pos")
    best = F.row_number().over(section.orderBy(F.desc("score"), "i")) == 1
    ranked = sentences.withColumn("n", F.count("*").over(request)).withColumn("r", F.when(best, 0).otherwise(F.row_number().over(request.orderBy(F.desc("score"), "pos", "i"))))
    widths = sorted({p.neighbours for p in prunings})
    near = [F.min("r").over(section.orderBy("i").rowsBetween(-w, w)).alias(f"r{w}") for w in widths]
    told = ranked.select("req_id", "budget", "pos", "i", text.clean(F.col("sentence")).alias("sentence"), "n", *near)
    each = told.groupBy("req_id", "budget", "pos").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "sentence", *(f"r{w}" for w in widths)))).alias("s"))
    rows = windows.join(each, ["req_id", "budget", "pos"], "left").join(facts, "req_id").withColumn("s", F.coalesce("s", F.array().cast(each.schema["s"].dataType)))

    def body(p: Pruning) -> Column:
        if p.ratio >= 1:
            return F.col("body")
        least = F.greatest(F.lit(1), F.ceil(F.lit(float(p.ratio)) * F.col("n")))
        return F.array_join(F.transform(F.filter("s", lambda x: x[f"r{p.neighbours}"] <= least), lambda x: x.sentence), " ")

    bodies = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p.name).alias("config"), body(p).alias("kept")) for i, p in enumerate(prunings)))
    pruned = rows.select("req_id", "budget", "tokens", "facts", F.inline(bodies))
    holds = F.transform(F.filter("facts", lambda f: F.contains(F.lower(F.col("kept")), f.fact)), lambda f: f.k)
    counted = pruned.select("req_id", "budget", "tokens", F.size("facts").alias("n_facts"), "place", "config", text.approx_tokens(F.col("kept")).alias("after"), holds.alias("holds"))
    return counted.groupBy("req_id", "budget", "place", "config").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("holds")))) == F.max("n_facts")).alias("all_facts"), F.sum("tokens").alias("windowed"), F.sum("after").alias("after")
    )


def score_prunings(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per seed, split, window budget and pruning: the share with all facts, mean tokens, and what is saved of the window's
    tokens and of the original ones. ``results`` has cluster_id and original, too."""
    n = F.count("*")
    return results.join(clusters, "cluster_id").groupBy("seed", "split", "budget", "config", "place").agg(
        n.alias("queries"),
        F.bround(F.count_if("all_facts") / n, 4).alias("all_facts_kept"),
        F.bround(F.sum("windowed") / n, 0).alias("avg_tokens_after_window"),
        F.bround(F.sum("after") / n, 0).alias("avg_tokens_after_compression"),
        F.bround(1 - F.sum("after") / F.nullif(F.sum("windowed"), F.lit(0)), 4).alias("saved_of_windowed"),
        F.bround(1 - F.sum("after") / F.nullif(F.sum("original"), F.lit(0)), 4).alias("saved_of_original"),
    )


def chosen_prunings(scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Per seed and window budget the pruning with the fewest tokens among those that in training keep all facts nearly as
    often as none (ties to the first in the list), with its scores on the test clusters and none's beside them."""
    train, test = (scores.where(F.col("split") == s) for s in ("train", "test"))
    none = train.where("config = 'none'").select("seed", "budget", F.col("all_facts_kept").alias("train_without"))
    order = Window.partitionBy("seed", "budget").orderBy("avg_tokens_after_compression", "place")
    able = train.join(none, ["seed", "budget"]).where(F.col("all_facts_kept") >= F.col("train_without") - F.lit(margin))
    best = able.withColumn("r", F.row_number().over(order)).where("r = 1").select("seed", "budget", "config", "train_without", F.col("all_facts_kept").alias("train_chosen"))
    told = test.select("seed", "budget", "config", F.col("queries").alias("test_queries"), F.col("all_facts_kept").alias("test_chosen"), F.col("avg_tokens_after_compression").alias("test_tokens"), "saved_of_windowed", "saved_of_original")
    before = test.where("config = 'none'").select("seed", "budget", F.col("all_facts_kept").alias("test_without"))
    return best.join(told, ["seed", "budget", "config"], "left").join(before, ["seed", "budget"], "left")


def cost_summary(answers: DataFrame, judge_cost: float, base: str = "baseline") -> DataFrame:
    """Per pipeline: cost, grades and how requests were served.

    ``answers`` has (pipeline, layer, model, cost_usd, verdict, score, input_tokens). The judge of the semantic cache is
    paid once by each pipeline but the base. The mean is over scores that are numbers; verdicts other than correct,
    partial and wrong count as unparsed.
    """
    n, micro = F.count("*"), F.lit(round(judge_cost * 1e6))
    score = F.expr("try_cast(score as double)")
    totals = answers.groupBy("pipeline").agg(
        n.alias("queries"),
        (F.sum(F.rint(F.col("cost_usd") * 1e6).cast("long")) + F.when(F.col("pipeline") == base, 0).otherwise(micro)).alias("micros"),
        *(F.bround(F.count_if(F.col("verdict") == v) / n, 4).alias(v) for v in ("correct", "partial", "wrong")),
        F.count_if(~F.coalesce(F.col("verdict").isin("correct", "partial", "wrong"), F.lit(False))).alias("unparsed"),
        F.bround(F.sum(F.rint(score * 100).cast("long")) / F.greatest(F.lit(1), F.count(score)) / 100, 3).alias("mean_score"),
        F.count_if(F.col("layer") != "llm").alias("cached"),
        F.count_if(F.col("model") == "small").alias("small"),
        F.count_if(F.col("model") == "large").alias("large"),
        F.sum("input_tokens").alias("input_tokens"),
    )
    first = totals.where(F.col("pipeline") == base).select(F.col("micros").alias("_base"))
    told = totals.join(F.broadcast(first))
    return told.select("pipeline", "queries", (F.col("micros") / F.lit(1e6)).alias("cost_usd"), (F.col("micros") / (F.col("queries") * F.lit(1000.0))).alias("per_1k"), (F.col("micros") / F.nullif(F.col("_base"), F.lit(0))).alias("vs_base"), "correct", "partial", "wrong", "unparsed", "mean_score", "cached", "small", "large", "input_tokens")


def layer_summary(answers: DataFrame) -> DataFrame:
    """Per pipeline, layer and model: requests, shares of correct and wrong answers, cost."""
    n = F.count("*")
    return answers.groupBy("pipeline", "layer", F.coalesce("model", F.lit("")).alias("model")).agg(
        n.alias("queries"), F.bround(F.count_if(F.col("verdict") == "correct") / n, 4).alias("correct"), F.bround(F.count_if(F.col("verdict") == "wrong") / n, 4).alias("wrong"), (F.sum(F.rint(F.col("cost_usd") * 1e6).cast("long")) / F.lit(1e6)).alias("cost_usd")
    )


def labelled_pairs(rows: DataFrame) -> DataFrame:
    """Each row with the one that it paraphrases or may be confused with: id, kind, other_id and both queries.

    ``rows`` has (id, query, expected_cache, semantic_of, confusable_with). Rows of other kinds, or whose other row is
    unknown, are left out.
    """
    other = F.when(F.col("expected_cache") == "semantic_hit", F.col("semantic_of")).when(F.col("expected_cache") == "miss", F.col("confusable_with"))
    kind = F.when(F.col("expected_cache") == "semantic_hit", "paraphrase").otherwise("trap")
    mine = rows.select("id", "query", kind.alias("kind"), other.alias("other_id")).where("other_id is not null")
    return mine.join(rows.select(F.col("id").alias("other_id"), F.col("query").alias("other_query")), "other_id").select("id", "kind", "other_id", "query", "other_query")
