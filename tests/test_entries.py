"""Cache entries, keys, memo hooks and small selections on a few rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import vectors
from tallyspark.operators import cache, context, models, traffic
from tallyspark.sources import records


def entries(spark):
    rows = [("a", "exact", 1), ("a", "exact", 2), ("a", "semantic", 3), ("b", "exact", 4), (None, "exact", 5)]
    return spark.createDataFrame(rows, "tenant string, kind string, id int")


def test_counting_and_clearing_entries(spark):
    table = entries(spark)
    assert {(r.kind, r["count"]) for r in cache.entry_counts(table, "a").collect()} == {("exact", 2), ("semantic", 1)}
    assert {(r.kind, r["count"]) for r in cache.entry_counts(table).collect()} == {("exact", 4), ("semantic", 1)}
    left, gone = cache.clear(table, "a")
    assert gone == 3 and {r.id for r in left.collect()} == {4, 5}
    left, gone = cache.clear(table)
    assert gone == 5 and left.count() == 0


def test_hashes_of_a_context_are_a_set(spark):
    df = spark.createDataFrame([(["x", "y", "x"], "case"), (["x"], None)], "docs array<string>, c string")
    got = [r.h for r in df.select(cache.context_hashes(F.col("docs"), F.col("c")).alias("h")).collect()]
    assert got[0] == sorted(["x", "y", "case:" + hashlib.sha256(b"case").hexdigest()]) and got[1] == ["case:none", "x"]


def test_a_live_key_names_its_version(spark):
    assert spark.range(1).select(records.live_key("abc", F.lit("k")).alias("k")).first().k == "abc:k"


def test_only_sound_answers_are_stored(spark):
    rows = [(True, "end", "text", True), (False, "end", "text", False), (True, "refusal", "text", False), (True, None, "text", True), (True, "end", "", False), (True, "end", None, False)]
    df = spark.createDataFrame(rows, "u boolean, s string, a string, want boolean")
    assert all(r.got == r.want for r in df.select("want", models.storable(F.col("u"), F.col("s"), F.col("a")).alias("got")).collect())


def test_each_distinct_text_is_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f.assign(vec=[[float(len(t))] for t in f["text"]])

        return texts.mapInPandas(run, "text string, vec array<double>")

    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab")], "id int, q string")
    assert {(r.id, r.vec[0]) for r in models.embed(rows, "q", model).collect()} == {(1, 2.0), (2, 3.0), (3, 2.0)} and seen.value == 2


def test_estimates_and_mock_answers(spark):
    row = spark.range(1).select(models.estimated_tokens(F.lit("be brief"), F.lit("one two three")).alias("n"), models.mock_answer(F.lit("hi")).alias("m")).first()
    # Five words are 6 tokens; 6 * 1.3 is cut to 7.
    assert (row.n, row.m) == (7, "[mock] hi")


def test_boilerplate_of_corpus_and_request_is_united(spark):
    both = context.united_boilerplate(spark.createDataFrame([("a", 3), ("b", 4)], "sentence string, n_docs long"), spark.createDataFrame([("b", 3), ("c", 3)], "sentence string, n_docs long"))
    assert sorted(r.sentence for r in both.collect()) == ["a", "b", "c"]


def test_a_case_counts_towards_a_large_context(spark):
    sections = spark.createDataFrame([(1, 700), (1, 700), (2, 700), (2, 700), (3, 1600)], "req_id int, tokens int")
    cases = spark.createDataFrame([(1, 100)], "req_id int, case_tokens int")
    assert {r.req_id for r in context.eligible(sections, cases).collect()} == {1} and context.eligible(sections).count() == 0


def test_the_optimised_context_has_its_case_and_kept_sections(spark):
    kept = F.array(F.struct(F.lit("T - a").alias("header"), F.lit("x").alias("body")), F.struct(F.lit("T - b").alias("header"), F.lit("y").alias("body")))
    row = spark.range(1).select(context.optimised(F.lit("c"), kept).alias("a"), context.optimised(F.lit(None).cast("string"), kept).alias("b")).first()
    assert row.b == "## T - a\nx\n\n## T - b\ny" and row.a == "## Case\nc\n\n" + row.b


def test_the_row_before_over_many_ranges(spark):
    rows = [(i % 2, i * 37 % 211, f"v{i}") for i in range(211)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = {(r.k, r.o): r.b for r in traffic.previous(df, ["k"], ["o"], "v", "b", parts=9).collect()}
    for k in (0, 1):
        mine = sorted((o, v) for kk, o, v in rows if kk == k)
        assert [got[k, o] for o, _ in mine] == [None, *(v for _, v in mine[:-1])]


def test_nearest_entries_over_several_blocks(spark):
    rows = [(i, i % 2, [float((i * 7919) % 101 - 50), float((i * 104729) % 89 - 44)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = {}
    for r in vectors.knn(df.where("id % 10 = 0"), df, "id", "v", "g", 3, block=16).collect():
        got.setdefault(r.a, []).append((r.rank, r.b))
    for i, g, v in rows[::10]:
        near = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for j, h, w in rows if h == g and j != i)[:3]
        assert [b for _, b in sorted(got[i])] == [j for _, j in near]


def test_a_lazy_judge_looks_no_further_than_the_first_yes(spark):
    pairs = [(1, 5, 0.9, False), (2, 5, 0.8, True), (3, 5, 0.7, True), (4, 5, 0.95, False), (1, 6, 0.9, False)]
    done = [(1, False), (2, False), (3, False), (4, True), (5, True), (6, False)]
    got = cache.consulted(spark.createDataFrame(pairs, "src long, dst long, cos double, passes boolean"), spark.createDataFrame(done, "seq long, hit boolean"))
    assert sorted((r.src, r.dst) for r in got.collect()) == [(1, 5), (1, 6), (2, 5)]


def chained(n, seed):
    draw = random.Random(seed)
    edges = {(j, i) for i in range(n) for j in draw.sample(range(i), min(i, draw.randint(0, 3)))}
    return sorted(edges)


def test_rows_that_all_depend_on_each_other_take_as_many_rounds_as_blocks(spark, monkeypatch):
    rounds = []
    written = scratch.stage
    monkeypatch.setattr(scratch, "stage", lambda df, name: rounds.append(name) or written(df, name))
    n = 10_000
    rows = spark.range(n).withColumnRenamed("id", "seq")
    got = cache.greedy_replay(rows, rows.where(F.col("seq") > 0).select((F.col("seq") - 1).alias("src"), F.col("seq").alias("dst")))
    assert got.where(F.col("hit") != (F.col("seq") % 2 == 1)).count() == 0 and got.count() == n
    assert rounds.count("replay-known") <= -(-n // cache.SWEEP_ROWS)


@pytest.mark.parametrize("block", [3, 16])
def test_replays_in_blocks_equal_the_folds(spark, block):
    draw = random.Random(block)
    pairs = [(j, i, round(draw.random(), 2), draw.random() < 0.5) for j, i in chained(90, block)]
    rows = spark.range(90).withColumnRenamed("id", "seq")
    entries, want = [], {}
    for i in range(90):
        if not any(j in entries for j, k, _, _ in pairs if k == i):
            entries.append(i)
        want[i] = i not in entries
    edges = spark.createDataFrame(pairs, "src long, dst long, cos double, passes boolean")
    assert {r.seq: r.hit for r in cache.greedy_replay(rows, edges, block=block).collect()} == want
    entries, want = [], {}
    for i in range(90):
        near = sorted((-c, j, p) for j, k, c, p in pairs if k == i and j in entries)[:2]
        served = next(((j, -c) for c, j, p in near if p), None)
        if not served:
            entries.append(i)
        want[i] = (True, *served) if served else (False, None, -near[0][0] if near else None)
    assert {r.seq: (r.hit, r.served_from, r.cosine) for r in cache.nearest_replay(rows, edges, 2, block=block).collect()} == want


def clustered(seed, n):
    """Vectors around a few directions, at many lengths."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 16))
    return [(i, i % 2, (centres[i % 12] * (1 + 0.05 * draw.normal(size=16)) / np.linalg.norm(centres[i % 12])).tolist()) for i in range(n)] + [(n, 0, [0.0] * 16)]


def test_cones_drop_pairs_of_blocks_but_no_pair_of_vectors(spark):
    rows = clustered(1, 700)
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", "g", 0.9, block=8).collect()}
    v, g = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    a, b = np.nonzero(np.triu((v @ v.T >= 0.9) & (g[:, None] == g[None, :]), 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 1000
    blocks, pairs = vectors.facing_blocks(df, "id", "v", "g", 0.9, block=8)
    per_group = [r["count"] for r in blocks.cones.groupBy("grp").count().collect()]
    assert pairs.count() < 0.5 * sum(n * (n + 1) // 2 for n in per_group)


def test_nearest_entries_among_cones(spark):
    rows = clustered(2, 400)
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = {}
    for r in vectors.knn(df.where("id % 7 = 0"), df, "id", "v", "g", 4, block=8).collect():
        got.setdefault(r.a, []).append((r.rank, r.b))
    v = np.array([r[2] for r in rows])
    for i, g, _ in rows[::7]:
        near = sorted((-float(v[i] @ v[j]), j) for j, h, _ in rows if h == g and j != i)[:4]
        assert [b for _, b in sorted(got[i])] == [j for _, j in near]


def test_places_over_many_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1009 - 300,) for i in range(1009)] + [(5,), (None,)], "k long")
    got = {r.k: r.place for r in traffic.places(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted({i * 7919 % 1009 - 300 for i in range(1009)} | {5}))}
