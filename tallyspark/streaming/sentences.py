"""Document frequencies of sentences, kept up to date as documents arrive in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.operators import context

SCHEMA = "sentence string, n_docs long"
#: Counts by the sentence's hashes, and the texts that they stand for.
COUNTED, TEXTS = "h long, g int, n_docs long", "h long, g int, sentence string"


def runs(n_batches: int) -> list[tuple[int, int]]:
    """The runs (first batch, last batch) that together hold the first ``n_batches``: one for each bit of the number."""
    found, start = [], 0
    for bit in reversed(range(n_batches.bit_length())):
        if n_batches >> bit & 1:
            found.append((start, start + (1 << bit) - 1))
            start += 1 << bit
    return found


class SentenceCounts:
    """(sentence, n_docs) over all micro-batches so far, in tables under ``path``; ``merge`` is for ``foreachBatch``.

    A batch's texts are written once, by the tasks that split them, and from there on only their hashes move. Those are
    counted with the runs that end just before the batch, as a binary counter carries: each row of hashes is written again
    once for each doubling of the number of batches, and a reader sums one run a bit, then looks up the texts that it
    wants. Which runs there are follows from the batch's number alone, so that a batch that comes again after a failure
    writes the same tables once more, and a new driver goes on from the folder.

    A document's sections are to arrive in one batch (a split of whole documents does so); within it repeated rows count
    once. Null bodies have no sentence, a null doc_id is a document like others, an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _place(self, run: tuple[int, int]) -> str:
        return f"{self.path}/{run[0]}-{run[1]}"

    def _texts(self, batch_id: int) -> str:
        return f"{self.path}/texts/{batch_id}"

    def _read(self, spark: SparkSession, wanted: list[tuple[int, int]]) -> DataFrame:
        return spark.read.schema(COUNTED).parquet(*map(self._place, wanted)) if wanted else spark.createDataFrame([], COUNTED)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch of sections (doc_id, body)."""
        spark = batch.sparkSession
        before, now = runs(batch_id), runs(batch_id + 1)
        said = context.hashed_sentences(batch)
        said.write.mode("overwrite").option("compression", "zstd").parquet(self._texts(batch_id))
        each = spark.read.schema(said.schema).parquet(self._texts(batch_id)).select("doc_id", "h", "g").distinct()
        carried = [run for run in before if run not in now]
        # Partial sums meet per hash: a hot sentence is one row a task.
        counted = each.select("h", "g", F.lit(1).cast("long").alias("n_docs")).union(self._read(spark, carried))
        counted.groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs")).write.mode("overwrite").parquet(self._place(now[-1]))
        # What the batch before carried is needed no more: that batch is settled, since this one has come.
        for run in set(runs(batch_id - 1) if batch_id else []) - set(before):
            scratch.remove(spark, self._place(run))

    def n_batches(self) -> int:
        """How many batches have been taken in whole, by the tables that are there."""
        ends = [int(name.split("-")[1]) + 1 for name in scratch.finished(self.spark, self.path)]
        return max(ends, default=0)

    def counts(self, n_batches: int | None = None, least_docs: int = 1) -> DataFrame:
        """(sentence, n_docs) over the first ``n_batches``: all of them, or the last but one."""
        n = self.n_batches() if n_batches is None else n_batches
        if not n:
            return self.spark.createDataFrame([], SCHEMA)
        found = self._read(self.spark, runs(n))
        if len(runs(n)) > 1:
            found = found.groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs"))
        return context.told(found.where(F.col("n_docs") >= least_docs), self.spark.read.schema(TEXTS).parquet(*map(self._texts, range(n))))

    def repeated(self, least_docs: int = 3) -> DataFrame:
        """As ``context.boilerplate`` over all rows that have arrived."""
        return self.counts(least_docs=least_docs)
