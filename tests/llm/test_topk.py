import math

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, asked, k, scale=1024):
    sound = {i: [math.floor(scale * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in sound if asked(i)):
        best = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def found(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_matches_brute_force_over_many_blocks(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.2 * draw.normal(size=8))]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # ties: the same vector many times
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = topk.search(df, F.col("vec_id") % 10 == 0, k=5, block=128)
    assert found(got) == brute(rows, lambda i: i % 10 == 0, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (None, [1.0, 1.0]), (5, [0.5, -0.5]), (10, [1.0, 2.0, 3.0]), (20, []), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows + [rows[0]]], SCHEMA)
    got = topk.search(df, F.col("vec_id") % 10 == 0, k=10)
    assert found(got) == brute(rows, lambda i: i % 10 == 0, 10) == {(0, 1, 7, 1024 * 1024 * 5), (0, 2, 5, 1024 * 512 - 2048 * 512)}
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_pruning_skips_pairs_and_loses_none():
    draw = np.random.default_rng(5)
    points = np.concatenate([draw.integers(-30, 30, size=(300, 4)) + c for c in ([900, 0, 0, 0], [-900, 0, 0, 0], [0, 900, 0, 0])])
    data, queries_ = topk.CoverTree(np.arange(900), points), topk.CoverTree(np.arange(10_000, 10_040), points[:40] + 1)
    search, seen = topk.Search(queries_, 3), []
    base = search.base
    search.base = lambda d, a, b: (seen.append((a, b)), base(d, a, b))[1]
    search.run(data)
    leaves = sum(not c for c in data.children) * sum(not c for c in queries_.children)
    assert 0 < len(seen) < leaves / 2
    scores = (points[:40] + 1) @ points.T
    for q, v, s in zip(*search.rows(), strict=True):
        assert scores[q - 10_000, v] == s
    assert sorted(search.scores[:, 0].tolist()) == sorted(scores.max(1).tolist())


def test_bounds_keep_far_blocks_from_being_sent(spark, monkeypatch):
    """Clusters far apart: most pairs of blocks are never searched, and the result is still exact."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (20 * np.eye(12)[i % 12] + 0.1 * draw.normal(size=12))]) for i in range(1500)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    staged, stage = {}, topk.scratch.stage
    monkeypatch.setattr(topk.scratch, "stage", lambda d, name: staged.setdefault(name, stage(d, name)))
    got = topk.search(df, F.col("vec_id") % 2 == 0, k=5, block=64)
    assert found(got) == brute(rows, lambda i: i % 2 == 0, 5)
    assert 0 < staged["late-pairs"].count() < 0.8 * staged["pairs"].count()


def test_block_bounds_hold():
    draw = np.random.default_rng(9)
    for _ in range(200):
        a, b = (draw.integers(-50, 50, 5) + draw.normal(size=(20, 5)) * draw.integers(1, 30) for _ in range(2))
        sides = [(x[0], float(np.sqrt(((x - x[0]) ** 2).sum(1)).max())) for x in (a, b)]
        assert (a @ b.T).max() <= topk.pair_bound(*sides)


def test_query_over_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(queries.op1_topk_search(spark, sf_dir)) == brute(rows, lambda i: i % 100 == 0, 10)
