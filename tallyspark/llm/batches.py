"""Arrow batches in small slices, so that a worker never holds a whole batch of texts as Python objects."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices; once they end, freed memory goes back, since workers live on for other stages."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def whole_row(docs: DataFrame) -> Column:
    """All columns in one, ``row``, so that no name of theirs can clash with a new one."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def texts_of(batch: pa.RecordBatch) -> list[str | None]:
    """The column ``text``, or that field of ``row``."""
    return (batch["text"] if "text" in batch.schema.names else batch["row"].field("text")).to_pylist()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to hand back


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Hold the session to so many rows and bytes an Arrow batch: with whole texts the defaults fill large buffers outside
    the executor's heap, once in the JVM and once in the worker. Smaller settings of the session's own stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is not None and not 0 < (int(now) if now.lstrip("-").isdigit() else 1 << 60) <= most:
            spark.conf.set(key, str(most))
