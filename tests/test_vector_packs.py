"""Replays by signs move a vector once a pack, not once a row and mode, and no texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.operators import signed
from tallyspark.plans import tables
from tests.test_signed import MODES, SCHEMA, drawn, fold


def vectors_in(value):
    if isinstance(value, (list, tuple)):
        return 1 if value and isinstance(value[0], float) and isinstance(value, list) else sum(map(vectors_in, value))
    return 0


def test_vectors_do_not_move_with_rows(spark, monkeypatch):
    """600 rows of eight vectors under three modes; 3037 vectors were written when they moved with rows."""
    held, written = [], scratch.stage

    def counted(df, name):
        table = written(df, name)
        if name.startswith("replay-"):
            held.append(sum(vectors_in(row) for row in table.collect()))
        return table

    monkeypatch.setattr(scratch, "stage", counted)
    draw = np.random.default_rng(5)
    pool = [(v / np.linalg.norm(v)).tolist() for v in draw.normal(size=(8, 4))]
    rows = [(i, 0, pool[i % 8], "abc"[i % 3], str(i % 5), i % 2) for i in range(600)]
    assert signed.signed_replay(spark.createDataFrame(rows, SCHEMA), MODES, [0.3, 0.8]).count() == 600 * 3 * 2
    assert sum(held) <= 8 * 3


@pytest.mark.parametrize(("asked", "told", "wide"), [(7, 1000, 1000), (1000, 5, 1000), (30, 30, 2)])
def test_any_packs_give_the_fold(spark, monkeypatch, asked, told, wide):
    monkeypatch.setattr(signed, "ASKED", asked)
    monkeypatch.setattr(signed, "TOLD", told)
    monkeypatch.setattr(signed, "VECTORS", wide)
    rows, thresholds = drawn(90, 11), [0.3, 0.6]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.col("seq") + 1)
    got = {}
    for r in signed.signed_replay(df, MODES, thresholds, ["more"]).collect():
        assert r.more == r.seq + 1
        got.setdefault((r.mode, r.threshold), []).append((r.seq, r.hit, r.served_from, r.cosine, r.miss_reason))
    assert got.keys() == {(m, t) for m in MODES for t in thresholds}
    for (mode, least), found in got.items():
        assert sorted(found) == fold(rows, MODES[mode], least)


@pytest.mark.parametrize(("few", "held", "slice_"), [(1 << 14, 1 << 22, 256), (0, 1 << 22, 256), (0, 32, 4), (20, 64, 8)])
def test_pairs_of_packs_are_all_found(monkeypatch, few, held, slice_):
    for name, value in (("FEW", few), ("HELD", held), ("SLICE", slice_)):
        monkeypatch.setattr(signed, name, value)
    draw = np.random.default_rng(few + held)

    def side(n):
        vs = draw.normal(size=(n, 3)).astype(np.float32)
        rows = [[{"key": int(draw.integers(3)), "seq": int(draw.integers(1000)), "bits": 1} for _ in range(draw.integers(1, 5))] for _ in range(n)]
        kind = pa.struct([("v", pa.list_(pa.float32())), ("rows", pa.list_(pa.struct([("key", pa.int64()), ("seq", pa.int64()), ("bits", pa.int64())])))])
        return signed._Side(pa.array([{"v": v.tolist(), "rows": r} for v, r in zip(vs, rows, strict=True)], kind))

    a, b = side(40), side(30)
    got = [(int(x), int(y), round(float(c), 9)) for xs, ys, cs in signed._pairs(a, b, 0.5) for x, y, c in zip(xs, ys, cs, strict=True)]
    cos = np.einsum("ij,kj->ik", a.v[a.at], b.v[b.at])
    good = (a.key[:, None] == b.key) & (b.seq < a.seq[:, None]) & (cos >= 0.5)
    assert sorted(got) == sorted((int(x), int(y), round(float(cos[x, y]), 9)) for x, y in zip(*np.nonzero(good), strict=True)) and got


@pytest.mark.parametrize("many", [600, 3000])
def test_a_group_is_sieved_in_slices(many):
    """More rows than a slice has, against the plain loop in order."""
    draw = np.random.default_rng(many)
    v = draw.normal(size=(many, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [{"seq": i, "v": x.tolist(), "key": i, "open": 3} for i, x in enumerate(v)]
    kind = pa.list_(pa.struct([("seq", pa.int64()), ("v", pa.list_(pa.float64())), ("key", pa.int64()), ("open", pa.int64())]))
    (got,) = signed._entries_of([0.6, 0.9])(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rows], kind)], ["g", "rows"])]))
    want, near = {}, np.round(v @ v.T, 6)
    for i in range(many):
        bits = sum(bit for bit, least in ((1, 0.6), (2, 0.9)) if not any(near[i, j] >= least and b & bit for j, b in want.items()))
        if bits:
            want[i] = bits
    assert dict(zip(got["seq"].to_pylist(), got["open"].to_pylist(), strict=True)) == want


def test_no_text_meets_vectors(spark, sf_dir):
    plan = tables.requests(spark, sf_dir, F.length("text").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan[: plan.index("length(text")] and plan.index("Join") < plan.index("length(text")
