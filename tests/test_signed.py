"""Replays by signs against the plain fold over rows in order; no pair of rows is kept on the way."""

import numpy as np
import pytest

from tallyspark import scratch
from tallyspark.functions import vectors
from tallyspark.operators import signed
from tallyspark.plans import cache_queries

SCHEMA = "seq long, grp int, v array<double>, context string, numbers string, negation int"
MODES = {"cosine": (), "context": ("context",), "guards": ("context", "numbers", "negation")}


def fold(rows, checked, least):
    """Plain Python: each row sees the entries so far."""
    names = ("context", "numbers", "negation")
    found, entries = [], []
    for seq, grp, v, *signs in sorted(rows):
        near = [(-round(float(np.dot(v, w)), 6), s, t) for s, g, w, t in entries if g == grp and round(float(np.dot(v, w)), 6) >= least]
        why = lambda t: next((f"{n}_mismatch" for n, a, b in zip(names, signs, t, strict=True) if n in checked and a != b and (n == "context" or None not in (a, b))), None)
        served = min(((c, s) for c, s, t in near if not why(t)), default=None)
        close = min(near, default=None)
        if served:
            found.append((seq, True, served[1], -served[0], None))
        else:
            found.append((seq, False, None, -close[0] if close else None, "empty" if not found else why(close[2]) if close else "low_cosine"))
            entries.append((seq, grp, v, signs))
    return found


def drawn(n, seed, unknown=False):
    """Few vectors, some of them short, and few signs, so that rows of equal vectors and signs are many."""
    draw = np.random.default_rng(seed)
    pool = [(v / np.linalg.norm(v) * (0.3 if i % 6 == 5 else 1)).tolist() for i, v in enumerate(draw.normal(size=(n // 4, 4)))]
    return [(int(3 * i - 40), int(draw.integers(2)), pool[draw.integers(len(pool))], "abc"[draw.integers(3)], None if unknown and i % 9 == 0 else str(draw.integers(2)), int(draw.integers(2))) for i in range(n)]


@pytest.mark.parametrize(("block", "unknown"), [(2048, False), (5, False), (2048, True)])
def test_equals_the_fold_under_each_mode_and_threshold(spark, monkeypatch, block, unknown):
    monkeypatch.setattr(signed, "SIEVE", block)
    monkeypatch.setattr(signed.entries, "__defaults__", (block,))
    monkeypatch.setattr(signed.nearest_before, "__defaults__", (block,))
    rows, thresholds = drawn(120, 3, unknown), [0.3, 0.55, 0.8]
    got = {}
    for r in signed.signed_replay(spark.createDataFrame(rows, SCHEMA), MODES, thresholds).collect():
        got.setdefault((r.mode, r.threshold), []).append((r.seq, r.hit, r.served_from, r.cosine, r.miss_reason))
    assert got.keys() == {(m, t) for m in MODES for t in thresholds}
    for (mode, least), found in got.items():
        assert sorted(found) == fold(rows, MODES[mode], least)
    single = signed.signed_replay(spark.createDataFrame(rows, SCHEMA), {"guards": MODES["guards"]}, [0.55]).collect()
    assert sorted((r.seq, r.hit, r.served_from, r.cosine, r.miss_reason) for r in single) == fold(rows, MODES["guards"], 0.55)


@pytest.mark.parametrize("name", ["semantic_replay", "semantic_modes", "semantic_sweep"])
def test_no_pairs_of_rows_are_kept(spark, sf_dir, monkeypatch, name):
    def fail(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(vectors, "similar_pairs", fail)
    assert cache_queries.QUERIES[name](spark, sf_dir).count() > 0


def test_one_common_vector_leaves_one_entry(spark, monkeypatch):
    """All rows alike: one class, so one row is sieved, however many rows there are."""
    sizes, written = {}, scratch.stage

    def counted(df, name):
        table = written(df, name)
        sizes.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(scratch, "stage", counted)
    rows = [(i, 0, [1.0, 0.0], "a", "n", 0) for i in range(500)]
    got = signed.signed_replay(spark.createDataFrame(rows, SCHEMA), {"guards": MODES["guards"]}, [0.9]).collect()
    assert {(r.hit, r.served_from) for r in got if r.seq} == {(True, 0)} and sizes["replay-leaders"] == [1]


def test_the_request_pipeline_keeps_no_pairs_either(spark, sf_dir, monkeypatch):
    from tallyspark.plans import request_pipeline

    def fail(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(vectors, "similar_pairs", fail)
    assert request_pipeline.request_pipeline(spark, sf_dir).count() > 0
