"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is a short list of insults and what labelled rows add to it: words, and beginnings of words, that toxic
texts have far more often than others. Features are densities of lexicon words, plain and behind obfuscation, their
nearness to the second person, and rates of capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches, texts_of, whole_row
from tallyspark.llm.textstats import DIGIT, LOWER, PUNCT, UPPER, WORD, counts

#: Labelled rows to learn from, at most; those with the lowest hashes of their ids.
MAX_LABELLED = 12_000
#: Toxic texts that must have a term, how much more often than others, and terms kept.
LEAST_TEXTS, LEAST_RATIO, MAX_TERMS = 4, 12.0, 4_000
PREFIXES = (4, 5, 6, 7, 8)
INSULTS = ("idiot", "moron", "loser", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "bitch", "asshole", "fuck", "retard", "dumbass")
SECOND_PERSON = frozenset("you your yours yourself youre ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti contigo tus vosotros".split())
NEAR = 6
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", ".": "", "-": "", "_": ""})
MIXED = re.compile(r"[^\W\d_]+[\d@$!|+*]+[^\W\d_][\w@$!|+*]*")
SPELT = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){3,}[^\W\d_](?!\w)")

FEATURES = ("lexicon", "lexicon_hits", "lexicon_weight", "hidden_hits", "nearness", "upper", "exclaim", "question", "punct", "digit", "obfuscated", "log_words")


class Lexicon(dict):
    """The weight of a word by itself or by its longest listed beginning; answers are kept, up to a bound."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        found = self.terms.get(word, 0.0)
        for k in reversed(PREFIXES):
            if not found and len(word) >= k:
                found = self.terms.get(word[:k] + "*", 0.0)
        self[word] = found
        return found


def terms_of(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values of FEATURES for a whole text; all zero for the empty one."""
    low = text.lower()
    words = WORD.findall(low)
    m = max(1, len(words))
    weights = list(map(lexicon.__getitem__, words))
    total = sum(weights)
    near = 0.0
    at = [i for i, w in enumerate(weights) if w] if total else []
    for i in at:
        for d in range(1, NEAR + 1):
            if (i >= d and words[i - d] in SECOND_PERSON) or (i + d < len(words) and words[i + d] in SECOND_PERSON):
                near = max(near, 1 / d)
                break
    masked = MIXED.findall(low) + SPELT.findall(low)
    hidden = sum(lexicon[x] > 0 for x in (y.translate(LEET) for y in masked) if x)
    by, n = counts(text), max(1, len(text))
    letters = max(1, by[UPPER].sum() + by[LOWER].sum())
    return [len(at) / m, min(len(at), 8), min(total, 40.0), min(hidden, 5), near, by[UPPER].sum() / letters, by[33] / n, by[63] / n, by[PUNCT].sum() / n, by[DIGIT].sum() / n, len(masked) / m, math.log1p(len(words))]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        seen = Counter(t for text in batch["text"].to_pylist() for t in terms_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])


def learn_terms(texts: DataFrame, least: int = LEAST_TEXTS, ratio: float = LEAST_RATIO, most: int = MAX_TERMS) -> dict[str, float]:
    """Terms of a bounded table (text, toxic) and their log ratios: the counts are Spark's, the list is bounded."""
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return {}
    often = texts.where("toxic = 1").select("text").mapInArrow(_candidates, "term string, n long").groupBy("term").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    picked = {r["term"]: r["a"] for r in often.orderBy(F.desc("a"), "term").limit(20 * most).collect()}

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in sliced(batches):
            for text in batch["text"].to_pylist():
                seen.update(terms_of(text) & picked.keys())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    clean = {r["term"]: r["b"] for r in texts.where("toxic = 0").select("text").mapInArrow(others, "term string, n long").groupBy("term").agg(F.sum("n").alias("b")).collect()}
    weights = {t: math.log((a + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_other + 1)) for t, a in picked.items()}
    # A ratio that few texts show is often chance: the count must stand out from what the others lead to expect.
    sure = {t: w for t, w in weights.items() if w >= math.log(ratio) and picked[t] - (clean.get(t, 0) + 1) * n_toxic / n_other >= 3 * math.sqrt((clean.get(t, 0) + 1) * n_toxic / n_other)}
    return dict(sorted(sure.items(), key=lambda x: (-x[1] * picked[x[0]], x[0]))[:most])


def _featured(docs: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """Features by the lexicon that ``part`` names; other columns than text pass through. Without a column text it is
    the field of that name of ``row``."""
    kept = [f for f in docs.schema if f.name not in ("text", "part")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Lexicon({w: 5.0 for w in INSULTS} | x) for x in lexicons]
        for batch in sliced(batches):
            rows = [features(t or "", known[p]) for t, p in zip(texts_of(batch), batch["part"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(rows, pa.list_(pa.float64()))], [*names, "x"])

    return docs.mapInArrow(run, StructType([*kept, StructField("x", ArrayType(DoubleType()))])).withColumn("x", array_to_vector("x"))


class Model:
    """A fitted scorer: ``score`` adds ``score`` and ``predicted`` to rows of (doc_id, text)."""

    def __init__(self, lexicon: dict[str, float], trees, curve, base: float):
        self.lexicon, self.trees, self.curve, self.base = lexicon, trees, curve, base

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score, predicted."""
        return self._scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("part")), "doc_id")

    def judge(self, docs: DataFrame) -> DataFrame:
        """row (all columns of a row as it is), score, predicted."""
        return self._scored(docs.select(whole_row(docs), F.lit(0).alias("part")), "row")

    def _scored(self, rows: DataFrame, kept: str) -> DataFrame:
        if self.trees is None:
            return rows.select(kept, F.lit(self.base).alias("score"), (F.lit(self.base) >= 0.5).cast("int").alias("predicted"))
        raw = _raw(self.trees, _featured(rows, [self.lexicon]))
        score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return self.curve.transform(raw).select(kept, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _raw(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "x")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> Model:
    """Learn from at most ``max_labelled`` labelled rows outside the held-out fifth.

    Two halves of the sample each find a lexicon; trees train on features by the other half's, so that no text is
    described by its own label, and the isotonic curve on a fifth that the trees don't see. Repeated labels of a
    document count as toxic if one does; null labels and ids are left out. With one class only, every score is
    that class's rate (0 without labels).
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    draw = F.xxhash64("doc_id")
    sample = known.orderBy(draw, "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = scratch.stage(rows.withColumn("part", (F.pmod(draw, F.lit(2))).cast("int")).withColumn("late", F.pmod(F.hash("doc_id"), F.lit(5)) == 0), "toxic-sample")
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return Model({}, None, None, float(next(iter(classes), 0)))
    halves = [learn_terms(rows.where(F.col("part") != p)) for p in (0, 1)]
    table = scratch.stage(_featured(rows.select("doc_id", "toxic", "late", "part", "text"), halves), "toxic-features")
    early, late = table.where("not late"), table.where("late")
    if min(early.groupBy().agg(F.countDistinct("toxic")).first()[0], late.groupBy().agg(F.countDistinct("toxic")).first()[0]) < 2:
        early = late = table
    trees = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=20, maxDepth=3, maxBins=64, stepSize=0.2, seed=seed).fit(early.repartition(4, "doc_id"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score").fit(_raw(trees, late).withColumn("toxic", F.col("toxic").cast("double")))
    model = Model(learn_terms(rows), trees, curve, 0.0)
    scratch.drop(rows, table)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 up) of every row, repeated rows included.

    Null texts are scored as empty ones. Columns other than doc_id and text are never read; an empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    scored = fit(docs, labels, max_labelled).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def judge_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """row, score, predicted of every row: each by its own text, whatever its id, with all its columns in ``row``."""
    small_batches(docs.sparkSession)
    return fit(docs, labels, max_labelled).judge(docs)
