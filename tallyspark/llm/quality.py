"""Quality by co-training: a text view and a page-metadata view teach each other, then score together.

Documents are described once, and the table of descriptions is what views are fitted on and score. In each round both
views look at every document without a label; each passes on the share it is most sure of, per class, to the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches, texts_of, whole_row
from tallyspark.llm.textstats import text_stats
from tallyspark.llm.toxicity import held_out

#: Rows with labels to learn from, at most; those with the lowest hashes of their ids.
MAX_LABELLED = 8_000
ROUNDS = 3
#: The share of all documents without a label that a view passes on in a round, dealt to the classes by their rates.
SHARE = 0.1
#: Calibrated probabilities stay this far from 0 and 1, and those that weigh a lesson as well.
EDGE = 0.005
_CATEGORIES = ["lang", "source", "origin", "length"]


def _described(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The named columns of ``docs`` with x_text, numbers that describe the text, as an array."""
    schema = StructType([*(f for f in docs.schema if f.name in kept), StructField("x_text", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [text_stats(t or "") for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in schema.names[:-1]), pa.array(rows, pa.list_(pa.float64()))], schema.names)

    return docs.mapInArrow(run, schema)


def _views(rows: DataFrame) -> DataFrame:
    """Both views as vectors: x_text, and x_meta of language, source, both together and the declared length."""
    for c in ("lang", "source"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    declared = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("declared", declared).withColumn("origin", F.concat_ws("|", "lang", "source")).withColumn("length", F.floor(2 * declared).cast("string"))
    hasher = FeatureHasher(inputCols=[*_CATEGORIES, "declared"], outputCol="x_meta", numFeatures=256, categoricalCols=_CATEGORIES)
    return hasher.transform(rows.withColumn("x_text", array_to_vector("x_text"))).drop("declared", *_CATEGORIES, "n_chars")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


class View:
    """A classifier over one column of features, with an isotonic curve."""

    def __init__(self, name: str):
        self.name, self.model, self.curve = name, None, None

    def fit(self, rows: DataFrame) -> None:
        common = {"featuresCol": f"x_{self.name}", "labelCol": "y", "weightCol": "weight", "probabilityCol": "p", "rawPredictionCol": "raw", "predictionCol": "guess"}
        if self.name == "text":
            learner = RandomForestClassifier(numTrees=24, maxDepth=7, minInstancesPerNode=4, seed=11, **common)
        else:
            learner = LogisticRegression(maxIter=25, regParam=0.01, **common)
        self.model = learner.fit(rows)

    def says(self, rows: DataFrame) -> DataFrame:
        """Rows with ``says_<name>``, the uncalibrated probability of label 1."""
        return self.model.transform(rows).withColumn(f"says_{self.name}", vector_to_array("p")[1]).drop("p", "raw", "guess")

    def calibrate(self, rows: DataFrame) -> None:
        self.curve = IsotonicRegression(featuresCol=f"says_{self.name}", labelCol="y", predictionCol=f"{self.name}_score").fit(self.says(rows))

    def judge(self, rows: DataFrame) -> DataFrame:
        """Rows with ``says_<name>`` and ``<name>_score``, the calibrated probability."""
        return PipelineModel([self.curve]).transform(self.says(rows))

    def score(self, rows: DataFrame) -> DataFrame:
        return self.judge(rows).drop(f"says_{self.name}")


class Model:
    def __init__(self, views: list[View], prior: float):
        #: Per round and teaching view, how many labels of each class were passed on.
        self.views, self.prior, self.exchanged = views, prior, []

    def score(self, rows: DataFrame, kept: str) -> DataFrame:
        """The named column of described rows with text_score, meta_score, score and keep."""
        if not self.views:
            return rows.select(kept, *(F.lit(self.prior).alias(c) for c in ("text_score", "meta_score", "score")), F.lit(self.prior >= 0.5).alias("keep"))
        rows = _views(rows)
        for view in self.views:
            rows = view.score(rows)
        # Given the label the views are taken as independent, so their odds multiply and one prior is taken out.
        odds = _logit(F.col("text_score")) + _logit(F.col("meta_score")) - _logit(F.lit(self.prior))
        return rows.select(kept, "text_score", "meta_score", (1 / (1 + F.exp(-odds))).alias("score")).withColumn("keep", F.col("score") >= 0.5)


def lesson(said: DataFrame, teacher: str, share: float, prior: float) -> DataFrame:
    """The rows that a view is most sure of, by class, with their labels ``y``.

    Each class gets its rate of the share. Equal probabilities are told apart by a hash, so that a view of few values
    passes on no more. A label weighs as much as the view's calibrated odds (``<teacher>_score``) differ from the class
    rate's: a view that knows little teaches little, however sure it is of itself.
    """
    p = F.col(f"says_{teacher}")
    ranked = said.withColumn("_p", p + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.lit(2.0**-50))
    cuts = ranked.agg(F.percentile_approx("_p", [share * (1 - prior), 1 - share * prior], 10_000)).first()[0]
    views = ("_p", "says_text", "says_meta", "text_score", "meta_score")
    if cuts is None:
        return ranked.limit(0).withColumn("y", F.lit(1.0)).withColumn("weight", F.lit(1.0)).drop(*views)
    weight = F.least(F.lit(1.0), F.abs(_logit(F.col(f"{teacher}_score")) - _logit(F.lit(prior))) / 4)
    chosen = ranked.where((F.col("_p") <= cuts[0]) | (F.col("_p") >= cuts[1]))
    return chosen.withColumn("y", (F.col("_p") >= cuts[1]).cast("double")).withColumn("weight", F.greatest(F.lit(0.01), weight)).drop(*views)


def fit(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Co-train on described rows (doc_id, lang, source, n_chars, x_text): a bounded sample of labelled ones (outside
    the held-out fifth) and all without a label.

    A quarter of the labelled sample only calibrates. Null labels and ids are left out; a document with several labels
    has quality 1 if one says so. With a single class, in the labels or in those that meet a document, every score is
    that class's rate. If labels meet no document it is the labels' rate, and 0 with no label at all.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    marked = scratch.stage(known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "quality-labels")
    base = marked.agg(F.avg("y"), F.countDistinct("y")).first()
    if (base[1] or 0) < 2:
        return Model([], float(base[0] or 0.0))
    taught = _views(rows.join(F.broadcast(marked), "doc_id").dropDuplicates(["doc_id"])).withColumn("weight", F.lit(1.0))
    taught = scratch.stage(taught, "quality-sample")
    met = taught.agg(F.avg("y"), F.countDistinct("y")).first()
    if met[1] < 2:
        return Model([], float(base[0] if met[0] is None else met[0]))
    late = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    train, check = taught.where(~late), taught.where(late)
    if check.agg(F.countDistinct("y")).first()[0] < 2 or train.agg(F.countDistinct("y")).first()[0] < 2:
        train = check = taught
    pool = _views(rows.where("doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti"))
    model = Model([View("text"), View("meta")], min(max(float(base[0]), EDGE), 1 - EDGE))
    lessons: list[DataFrame | None] = [None, None]
    for turn in range(rounds):
        for view, told in zip(model.views, lessons, strict=True):
            view.fit(train if told is None else train.unionByName(told))
            view.calibrate(check)
        if turn + 1 < rounds:
            said = scratch.stage(model.views[1].judge(model.views[0].judge(pool)), "co-training")
            spent, lessons = lessons, [scratch.stage(lesson(said, teacher, share, model.prior), "lesson") for teacher in ("meta", "text")]
            model.exchanged.append({teacher: {int(r["y"]): r["count"] for r in told.groupBy("y").count().collect()} for teacher, told in zip(("meta", "text"), lessons, strict=True)})
            scratch.drop(said, *(x for x in spent if x is not None))
    scratch.drop(marked, taught, *(x for x in lessons if x is not None))
    return model


_META = ["lang", "source", "n_chars"]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (0 to 1, higher: quality 1 likelier), keep, for every row.

    Null texts and metadata count as empty, null lengths as 0; repeated rows get equal scores; columns other than
    doc_id, text, lang, source and n_chars are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = scratch.stage(_described(docs.select("doc_id", "text", *_META), ["doc_id", *_META]), "quality-described")
    scored = fit(rows, labels).score(rows, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", "score", "keep")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, score, keep of every row: each by its own text and metadata, whatever its id, with all its columns in ``row``."""
    small_batches(docs.sparkSession)
    rows = scratch.stage(_described(docs.select("doc_id", "text", *_META), ["doc_id", *_META]), "quality-described")
    model = fit(rows, labels)
    scratch.drop(rows)
    # Described once more with the whole row beside: texts needn't be written another time.
    whole = _described(docs.select(whole_row(docs)), ["row"])
    return model.score(whole.select("row", "x_text", *(F.col("row").getField(c).alias(c) for c in _META)), "row").select("row", "score", "keep")
