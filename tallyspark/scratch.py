"""Stage tables between jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Where staged tables are, as long as someone holds them.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, or a temporary one in local mode (tests).

    Without the setting a cluster session is an error, since a driver-local folder would not be seen by executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    return _OWN[context.applicationId]


def fresh(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: it is computed once, and lost executors cost no recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[staged] = path
    return staged


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table by its path; without Spark's own file system calls it stays."""
    jvm = getattr(spark, "_jvm", None)
    if jvm:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables in a folder that have been written to their end; none if the folder isn't there."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(mark.getPath().getParent().getName() for mark in found or [])


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no result is still to be read from."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path:
            remove(table.sparkSession, path)
