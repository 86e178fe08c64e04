"""Model routing: rules, a logistic router with out-of-fold probabilities, thresholds, and choices among configurations."""

from __future__ import annotations

import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import text
from tallyspark.operators import traffic

SMALL, LARGE = "small", "large"
T = TypeVar("T")
#: Fits that run at once: each is a row of short jobs, which leave most cores idle.
PARALLEL = 6
FEATURES = ["n_words", "n_sentences", "n_questions", "n_numbers", "n_connectives", "ends_right", "docs_kept", "log_tokens"]


def rules_route(query: Column, docs_kept: Column) -> Column:
    low = F.lower(query)
    hard = (F.regexp_count(query, F.lit(r"\?")) > 1) | low.contains(" instead") | low.contains(" or ") | text.ends_right(query) | (docs_kept > 1)
    return F.when(hard, LARGE).otherwise(SMALL)


def routing_label(difficulty: Column, context_size: Column) -> Column:
    """(suggested_model, small_model_ok, depends_on_pruning)"""
    easy = difficulty == "easy"
    return F.struct(F.when(easy, SMALL).otherwise(LARGE).alias("suggested_model"), easy.alias("small_model_ok"), (context_size == "large").alias("depends_on_pruning"))


def route_table(rows: DataFrame, query: str, docs_kept: str, tokens: str) -> DataFrame:
    """Adds the router's eight features."""
    return rows.withColumns({**text.route_features(F.col(query)), "docs_kept": F.col(docs_kept), "log_tokens": F.log1p(F.col(tokens))})


def fold_of_groups(sizes: list[tuple[str, int]], folds: int) -> dict[str, int]:
    """Whole groups dealt to folds: the largest first, each to the fold with the fewest rows. ``sizes`` is one row a group."""
    totals, found = [0] * folds, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        fold = min(range(folds), key=lambda f: (totals[f], f))
        found[name] = fold
        totals[fold] += n
    return found


def shuffled(names: list[str], seed: int) -> list[tuple[int, str]]:
    """A seeded permutation of a bounded list, to be joined as a table."""
    names = sorted(names)
    random.Random(seed).shuffle(names)
    return list(enumerate(names))


class Router:
    """A fitted router: adds ``p_large``, the probability that a query needs the large model."""

    def __init__(self, scaler: StandardScalerModel, model: LogisticRegressionModel, stretch: float, embedding: str):
        self.scaler, self.model, self.stretch, self.embedding = scaler, model, stretch, embedding

    def prepare(self, table: DataFrame) -> DataFrame:
        ready = self.scaler.transform(VectorAssembler(inputCols=FEATURES, outputCol="raw_features").transform(table))
        widened = F.transform(vector_to_array("scaled"), lambda v: v * F.lit(self.stretch))
        return ready.withColumn("x", array_to_vector(F.concat(F.col(self.embedding).cast("array<double>"), widened))).drop("raw_features", "scaled")

    def __call__(self, table: DataFrame) -> DataFrame:
        return self.model.transform(self.prepare(table)).withColumn("p_large", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.stretch, self.embedding)], "stretch double, embedding string").write.mode("overwrite").parquet(f"{path}/told")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Router:
        told = spark.read.parquet(f"{path}/told").first()
        return Router(StandardScalerModel.load(f"{path}/scaler"), LogisticRegressionModel.load(f"{path}/model"), told["stretch"], told["embedding"])


def load_or_fit(spark: SparkSession, path: str, rows: DataFrame, embedding: str, label: str) -> Router:
    """The router that was saved under ``path``; without one, a fitted one that is saved there."""
    try:
        return Router.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    router = fit_router(rows, embedding, label)
    router.save(spark, path)
    return router


def together(spark: SparkSession, tasks: list[Callable[[], T]], parallel: int = PARALLEL) -> list[T]:
    """What the tasks return, in their order; their Spark jobs run side by side, as in a cross-validator."""
    with ThreadPool(max(1, min(parallel, len(tasks)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(task) for task in tasks], chunksize=1)


def fit_router(rows: DataFrame, embedding: str, label: str) -> Router:
    """A balanced logistic regression (C = 1) over the embedding and the standardised features.

    Features are scaled by the deviation over all rows (not over n - 1), classes weigh the same, and the penalty is
    1 / n per row, none on standardised scale.
    """
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("ones")).first()
    n, ones = stats["n"], stats["ones"] or 0
    if not 0 < ones < n:
        raise ValueError("a router needs rows of both classes")
    weight = F.when(F.col(label) == 1, F.lit(n / (2 * ones))).otherwise(F.lit(n / (2 * (n - ones))))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="raw_features").transform(rows)
    scaler = StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True).fit(assembled)
    learner = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", maxIter=200, regParam=1.0 / n, standardization=False)
    router = Router(scaler, None, (n / (n - 1)) ** 0.5, embedding)
    router.model = learner.fit(router.prepare(rows).withColumn("weight", weight))
    return router


def out_of_fold(rows: DataFrame, group: str, embedding: str, label: str, folds: int = 5) -> DataFrame:
    """Rows with ``fold`` and ``p_large`` by a router that was fitted on the other folds; groups are never cut.

    One row per group comes to the driver, which deals them to folds.
    """
    sizes = [(r[0], r[1]) for r in rows.groupBy(F.col(group).cast("string")).count().collect()]
    dealt = fold_of_groups(sizes, max(2, min(folds, len(sizes))))
    spark = rows.sparkSession
    places = spark.createDataFrame(list(dealt.items()), "_group string, fold int")
    rows = scratch.stage(rows.withColumn("_group", F.col(group).cast("string")).join(F.broadcast(places), "_group").drop("_group"), "folds")
    used = sorted(set(dealt.values()))
    routers = together(spark, [lambda fold=fold: fit_router(rows.where(F.col("fold") != fold), embedding, label) for fold in used])
    found = None
    for fold, router in zip(used, routers, strict=True):
        part = router(rows.where(F.col("fold") == fold))
        found = part if found is None else found.unionByName(part)
    return found


def compare_strategies(train: DataFrame, test: DataFrame, group: str, embedding: str, label: str, target: float = 0.05) -> DataFrame:
    """Five strategies on the test rows: the router at a threshold that out-of-fold probabilities of the training rows
    call safe, the rules, the large or small model for all, and the labels themselves.

    Rows have the router's features, its embedding and label, ``text`` features of FEATURES and ``log_tokens``.
    """

    def safe() -> float:
        told = out_of_fold(train, group, embedding, label).select((F.col(label) == 1).alias("complex"), "p_large", F.lit(0).alias("all"))
        return safe_threshold(told, ["all"], target).first()["threshold"]

    threshold, router = together(train.sparkSession, [safe, lambda: fit_router(train, embedding, label)])
    rows = router(test).withColumn("complex", F.col(label) == 1)
    small, large = F.lit(SMALL), F.lit(LARGE)
    hard = (F.col("n_questions") > 1) | (F.col("ends_right") == 1) | (F.col("docs_kept") > 1)
    each = {
        "router": F.when(F.col("p_large") >= threshold, large).otherwise(small),
        "rules": F.when(hard, large).otherwise(small),
        "always_large": large,
        "always_small": small,
        "labels": F.when(F.col("complex"), large).otherwise(small),
    }
    tokens = F.rint(F.expm1("log_tokens") / 4).cast("long")
    routed = rows.select("complex", tokens.alias("tokens"), F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), c.alias("route")) for n, c in each.items()))))
    routed = routed.withColumn("cost_usd", traffic.billed(F.col("route"), F.col("tokens"), F.lit(120)))
    cost = routed.groupBy("strategy").agg((F.sum(traffic.micros(F.col("cost_usd"))) / (F.count("*") * F.lit(1000.0))).alias("per_1k"))
    return score_routes(routed, ["strategy"]).join(cost, "strategy").withColumn("threshold", F.when(F.col("strategy") == "router", F.lit(threshold)))


def safe_threshold(predictions: DataFrame, group: list[str], target: float = 0.0) -> DataFrame:
    """(group, threshold): the highest of .05, .10 ... .95 at which no more than ``target`` of complex rows go small.

    ``predictions`` has (p_large, complex). Each row meets the 19 thresholds as an array, not as a join.
    """
    grid = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.bround(i * F.lit(0.05), 2))
    each = predictions.select(*group, "complex", "p_large", F.explode(grid).alias("threshold"))
    rates = each.groupBy(*group, "threshold").agg((F.count_if(F.col("complex") & (F.col("p_large") < F.col("threshold"))) / F.greatest(F.lit(1), F.count_if("complex"))).alias("rate"))
    return rates.groupBy(*group).agg(F.coalesce(F.max(F.when(F.col("rate") <= target, F.col("threshold"))), F.lit(0.05)).alias("threshold"))


def score_routes(routed: DataFrame, group: list[str]) -> DataFrame:
    """Shares of complex rows sent small, of easy rows sent large, and of all rows sent small."""
    small = F.col("route") == SMALL
    return routed.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.bround(F.count_if(small & F.col("complex")) / F.greatest(F.lit(1), F.count_if("complex")), 4).alias("complex_to_small"),
        F.bround(F.count_if(~small & ~F.col("complex")) / F.greatest(F.lit(1), F.count_if(~F.col("complex"))), 4).alias("easy_to_large"),
        F.bround(F.count_if(small) / F.count("*"), 4).alias("share_small"),
    )


def best_config(scores: DataFrame, group: list[str], quality: str, cost: str, position: str) -> DataFrame:
    """The configuration with the highest quality, the lowest cost among those, the first among equals."""
    order = Window.partitionBy(*group).orderBy(F.desc(quality), cost, position)
    return scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def cheapest_within(scores: DataFrame, group: list[str], quality: str, cost: str, position: str, margin: float = 0.02) -> DataFrame:
    """The cheapest configuration whose quality is within ``margin`` of the first one's."""
    base = F.min_by(quality, position).over(Window.partitionBy(*group))
    order = Window.partitionBy(*group).orderBy(cost, position)
    return scores.withColumn("base", base).where(F.col(quality) >= F.col("base") - margin).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "base")
