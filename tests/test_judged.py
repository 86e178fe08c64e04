"""The judged replay against the plain fold over rows in order; no pair of rows is kept on the way."""

import numpy as np
import pytest

from tallyspark.functions import vectors
from tallyspark.operators import signed
from tallyspark.plans import source_queries

SCHEMA = "seq long, grp int, v array<double>, context string, numbers string, negation int, serves boolean, input_tokens int, output_tokens int"
SIGNS = ("context", "numbers", "negation")


def fold(rows, least):
    """Plain Python: each row asks the judge about its entries, nearest first, until one serves it."""
    found, entries = [], []
    for seq, grp, v, *signs, serves, given, said in sorted(rows):
        near = sorted((-round(float(np.dot(v, w)), 6), s, t, ok, cost) for s, g, w, t, ok, cost in entries if g == grp and round(float(np.dot(v, w)), 6) >= least)
        alike = [(s, ok, cost) for _, s, t, ok, cost in near if t == signs]
        at = next((i for i, (_, ok, _) in enumerate(alike) if ok), None)
        asked = alike if at is None else alike[: at + 1]
        found.append((seq, at is not None, None if at is None else alike[at][0], at is None and bool(near) and near[0][2] == signs, len(asked), sum(c[0] for *_, c in asked), sum(c[1] for *_, c in asked)))
        if at is None:
            entries.append((seq, grp, v, signs, serves, (given, said)))
    return found


def drawn(n, seed):
    """Few vectors, some of them short, and few signs."""
    draw = np.random.default_rng(seed)
    pool = [(v / np.linalg.norm(v) * (0.3 if i % 6 == 5 else 1)).tolist() for i, v in enumerate(draw.normal(size=(n // 4, 4)))]
    return [(int(3 * i - 40), int(draw.integers(2)), pool[draw.integers(len(pool))], "ab"[draw.integers(2)], str(draw.integers(2)), 0, bool(draw.random() < 0.4), int(draw.integers(1, 9)), int(draw.integers(1, 9))) for i in range(n)]


@pytest.mark.parametrize(("block", "least"), [(2048, 0.3), (5, 0.55), (5, 0.8)])
def test_equals_the_fold(spark, monkeypatch, block, least):
    monkeypatch.setattr(signed.entries, "__defaults__", (block,))
    rows = drawn(160, 7)
    got = signed.judged_replay(spark.createDataFrame(rows, SCHEMA), SIGNS, least, block).collect()
    names = ("seq", "hit", "served_from", "judged", "consulted", "judge_input", "judge_output")
    assert sorted(tuple(r[n] for n in names) for r in got) == fold(rows, least)


def test_no_pairs_of_rows_are_kept(spark, sf_dir, monkeypatch):
    def fail(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(vectors, "similar_pairs", fail)
    assert source_queries.judged_replay(spark, sf_dir).first()["queries"] > 0
