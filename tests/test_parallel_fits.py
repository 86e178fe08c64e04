"""Router fits run side by side: short jobs of one fit leave most cores idle."""

import threading

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import routing


def test_folds_are_fitted_at_once_and_keep_their_order(spark, monkeypatch):
    met = threading.Barrier(3)

    def fit(rows, embedding, label):
        met.wait(60)
        mine = {r.fold for r in rows.select("fold").distinct().collect()}
        return lambda test: test.withColumn("p_large", F.lit(float(sum(mine))))

    monkeypatch.setattr(routing, "fit_router", fit)
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "n int, source string")
    got = routing.out_of_fold(rows, "source", "v", "y", folds=3)
    assert {(r.fold, r.p_large) for r in got.collect()} == {(0, 3.0), (1, 2.0), (2, 1.0)} and got.count() == 30


def test_tasks_answer_in_order_and_errors_come_through(spark):
    assert routing.together(spark, [lambda k=k: spark.range(k).count() for k in (5, 1, 3)]) == [5, 1, 3]
    with pytest.raises(ZeroDivisionError):
        routing.together(spark, [lambda: 1 // 0, lambda: 1])
