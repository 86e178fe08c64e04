"""The live cache in blocks against the plain fold over rows in order; no pair of rows is kept on the way."""

import numpy as np
import pytest

from tallyspark.functions import vectors
from tallyspark.operators import live
from tallyspark.plans import cache_queries


def fold(rows, least, k):
    """Plain Python: each row checks its k nearest entries so far."""
    found, entries = [], []
    for g, no, v, sign in sorted(rows, key=lambda r: r[1]):
        near = sorted((-round(float(np.dot(v, w)), 6), n, s) for h, n, w, s in entries if h == g and np.dot(v, w) >= least)[:k]
        served = next((x for x in near if x[2] == sign), None)
        found.append((no, True, served[1], -served[0]) if served else (no, False, None, -near[0][0] if near else None))
        if not served:
            entries.append((g, no, v, sign))
    return found


@pytest.mark.parametrize(("block", "step", "k"), [(16_384, 256, 3), (40, 8, 3), (7, 256, 1)])
def test_equals_the_fold_in_blocks(spark, monkeypatch, block, step, k):
    monkeypatch.setattr(live, "SLICE", step)
    draw = np.random.default_rng(block)
    pool = [(v / np.linalg.norm(v) * (0.5 if i % 6 == 5 else 1)).tolist() for i, v in enumerate(draw.normal(size=(30, 4)))]
    pool[0] = pool[6]
    # Groups are runs of numbers, as a sort by them leaves.
    rows = [(i // 150, i + (i // 100 << 33), pool[draw.integers(30)], int(draw.integers(5))) for i in range(300)]
    got = live.replay(spark.createDataFrame(rows, "g long, no long, v array<double>, sign long"), 0.5, k, block).collect()
    want = fold(rows, 0.5, k)
    assert sorted(tuple(r) for r in got) == want and 50 < sum(r[1] for r in want) < 250


def test_live_cache_keeps_no_pairs_of_rows(spark, sf_dir, monkeypatch):
    def fail(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(vectors, "similar_pairs", fail)
    assert cache_queries.live_cache(spark, sf_dir).count() > 0


def test_no_rows_give_none(spark):
    assert live.replay(spark.createDataFrame([], "g long, no long, v array<double>, sign long"), 0.5, 3).count() == 0
