"""Folds, selections and replays against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cache, checks, context, models, routing, sampling, traffic


def packed(spark, tokens, budget=800):
    rows = spark.createDataFrame([("r", i, "s", t, float(-i)) for i, t in enumerate(tokens)], "req_id string, pos int, section string, tokens int, score double")
    row = context.section_first(rows, budget).first()
    return row.used, row.kept


@pytest.mark.parametrize(("tokens", "result"), [([500, 400, 250], (750, [0, 2])), ([900, 10], (900, [0])), ([10, 900, 20], (30, [0, 2]))])
def test_packing_skips_what_overflows(spark, tokens, result):
    assert packed(spark, tokens) == result


def test_hybrid_keeps_the_top_document_whole(spark):
    rows = spark.createDataFrame([(1, 10, 0, "a", 900, 0.9), (1, 11, 1, "a", 10, 0.5)], "req_id int, doc_id int, pos int, section string, tokens int, score double")
    row = context.hybrid(rows, rows).first()
    assert (row.top, row.used, row.kept) == (10, 900, [0])


@pytest.mark.parametrize(("body", "left"), [("R. B. C. D.", "B. C. D."), ("R. B. C.", None), ("B. C.", "B. C."), ("", "")])
def test_boilerplate_share(spark, body, left):
    sections = spark.createDataFrame([(1, 0, body)], "doc_id int, pos int, body string")
    got = context.strip_boilerplate(sections, spark.createDataFrame([("R.", 5)], "sentence string, n_docs long")).collect()
    assert [r.body for r in got] == ([] if left is None else [left])


def test_pruning_keeps_one_sentence_a_section(spark):
    rows = spark.createDataFrame([(1, 0, i, 1.0 - i / 100) for i in range(9)] + [(1, 1, 0, 0.0)], "req_id int, pos int, i int, score double")
    got = context.prune_sentences(rows, keep_ratio=0.7).collect()
    assert sum(r.pos == 0 for r in got) == 7 and sum(r.pos == 1 for r in got) == 1
    around = context.prune_sentences(rows.where("pos = 0"), keep_ratio=0.1, neighbours=1).collect()
    assert sorted(r.i for r in around) == [0, 1]


def test_exact_replay(spark):
    rows = spark.createDataFrame(list(enumerate("abaa", 1)), "seq long, key string")
    got = sorted((r.seq, r.hit, r.served_from) for r in cache.exact_replay(rows, "key", "seq").collect())
    assert got == [(1, False, None), (2, False, None), (3, True, 1), (4, True, 1)]


def test_a_hit_never_becomes_an_entry(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "seq long")
    edges = spark.createDataFrame([(1, 2, 0.95, None), (2, 3, 0.95, None)], "src long, dst long, cos double, reason string")
    got = {r.seq: (r.hit, r.served_from, r.miss_reason) for r in cache.semantic_replay(rows, edges).collect()}
    assert got == {1: (False, None, "empty"), 2: (True, 1, None), 3: (False, None, "low_cosine")}


def test_replay_equals_the_sequential_fold(spark):
    draw = random.Random(5)
    edges = sorted({(a, b) for a, b in (sorted(draw.sample(range(150), 2)) for _ in range(260))})
    misses = []
    for i in range(150):
        if not any(a in misses for a, b in edges if b == i):
            misses.append(i)
    done = cache.greedy_replay(spark.range(150).withColumnRenamed("id", "seq"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.seq for r in done.where("not hit").collect()} == set(misses) and done.count() == 150


def test_live_replay_takes_the_nearest_before_the_checks(spark):
    rows = [(1, i, [1.0, 0.001 * i], ["n"], []) for i in range(5)] + [(1, 9, [1.0, 0.1], ["other"], []), (1, 10, [1.0, 0.0], ["other"], []), (2, 1, [1.0, 0.0], [], [])]
    df = spark.createDataFrame(rows, "tenant int, seq long, vec array<double>, numbers array<string>, negations array<string>")
    got = {(r.tenant, r.seq): (r.hit, r.served_from) for r in cache.live_replay(df, 0.5, k=1).collect()}
    assert got[1, 1] == (True, 0) and got[1, 9] == (False, None) and got[2, 1] == (False, None)
    # Entry 9 would serve request 10, but entry 0 is nearer and fails the check.
    assert got[1, 10] == (False, None)
    assert {(r.tenant, r.seq): r.hit for r in cache.live_replay(df, 0.5, k=2).collect()}[1, 10] is True


@pytest.mark.parametrize("p", [0, 50, 95, 99, 100])
def test_nearest_rank(spark, p):
    draw = random.Random(p)
    for n in (1, 2, 10, 37):
        values = [draw.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([("a", v) for v in values], "k string, v int")
        want = sorted(values)[min(n - 1, round(p / 100 * (n - 1)))]
        assert traffic.nearest_ranks(df, ["k"], "v", (p,)).first()[f"p{p:g}"] == want
        assert df.agg(traffic.nearest_rank(F.collect_list("v"), p).alias("x")).first()["x"] == want
        assert traffic.upper_median(df, ["k"], "v").first()["median"] == sorted(values)[n // 2]


def test_running_totals_over_many_ranges(spark):
    rows = [(i % 3, i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {(r.k, r.o): r.total for r in traffic.running_total(df, ["k"], ["o"], F.col("v"), parts=7).collect()}
    assert got == {(k, o): sum(v for kk, oo, v in rows if kk == k and oo <= o) for k, o, _ in rows}


def test_thresholds_and_choices(spark):
    preds = spark.createDataFrame([("a", True, 0.42), ("a", True, 0.9), ("a", False, 0.1), ("b", True, 0.01)], "g string, complex boolean, p_large double")
    assert {r.g: r.threshold for r in routing.safe_threshold(preds, ["g"]).collect()} == {"a": 0.4, "b": 0.05}
    rows = spark.createDataFrame([("g", 0, 0.9, 100.0), ("g", 1, 0.9, 90.0), ("g", 2, 0.89, 10.0), ("g", 3, 0.5, 1.0)], "g string, i int, q double, c double")
    assert routing.best_config(rows, ["g"], "q", "c", "i").first()["i"] == 1
    assert routing.cheapest_within(rows, ["g"], "q", "c", "i").first()["i"] == 2
    folds = routing.fold_of_groups([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2)
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_gates_and_violations(spark):
    metrics = spark.createDataFrame([(0, 36)], "false_hits int, hits int")
    assert [r.ok for r in checks.gates(metrics, [("false_hits", "max", 0), ("hits", "min", 37)]).collect()] == [True, False]
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    assert [(r.id, r.rule) for r in checks.violations(rows, "id", {"has x": F.col("x") > 1}).collect()] == [(1, "has x")]


def test_memo_is_asked_once_and_offline_fails(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, query string")
    memo = spark.createDataFrame([("b", "B")], "query string, answer string")
    asked = []

    def ask(missing):
        asked.append(missing.count())
        return missing.withColumn("answer", F.upper("query"))

    got, fresh = models.memoised(rows, ["query"], memo, ask)
    assert {r.i: r.answer for r in got.collect()} == {1: "A", 2: "A", 3: "B"} and asked == [1] and fresh.count() == 1
    with pytest.raises(Exception, match="offline"):
        models.memoised(rows, ["query"], memo)[0].collect()
    assert models.memoised(rows.where("i = 3"), ["query"], memo)[0].first()["answer"] == "B"
    verdicts = spark.createDataFrame([("wrong", "partial"), ("correct", "correct"), (None, "wrong")], "a string, b string")
    assert [r.v for r in verdicts.select(models.quality_verdict(F.col("a"), F.col("b")).alias("v")).collect()] == ["worse", "equivalent", None]


def test_blind_grades_do_not_depend_on_order_and_slots_do_not_tell_pipelines(spark):
    rows = [(q, p, f"{p} says {q * k}") for q in range(60) for k, p in enumerate(("a", "b", "c"))]
    df = spark.createDataFrame(rows, "query_id int, pipeline string, answer string")
    grader = lambda shown: shown.withColumn("grade", F.length("answer"))
    one, two = (sorted(map(tuple, models.blind_grades(d, grader, seed=1).collect())) for d in (df, df.orderBy(F.desc("answer"))))
    assert one == two == sorted((q, p, len(a)) for q, p, a in rows)
    shown, key = models.blinded(df, seed=1)
    assert shown.columns == ["query_id", "slot", "answer"]
    first = [r.pipeline for r in key.where("slot = 1").collect()]
    assert all(8 < first.count(p) < 32 for p in "abc")
    other = [tuple(r) for r in models.blinded(df, seed=2)[1].collect()]
    assert sorted(other) != sorted(tuple(r) for r in key.collect())


def test_bundles_hold_what_is_required_and_no_document_twice(spark):
    pool = spark.range(0, 230, 10).withColumnRenamed("id", "doc")
    rows = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None), (4, [10, 10, 999]), (5, list(range(0, 100, 10)))], "id long, need array<long>")
    got = {r.id: r.bundle for r in sampling.bundles(rows, "id", "need", pool, "doc", 8, seed=1).collect()}
    assert all(len(b) == len(set(b)) == (10 if i == 5 else 8) for i, b in got.items()) and {10, 20} <= set(got[1]) and 10 in got[4] and 999 not in got[4] and set(got[5]) == set(range(0, 100, 10))
    assert got == {r.id: r.bundle for r in sampling.bundles(rows.repartition(3), "id", "need", pool, "doc", 8, seed=1).collect()}
    assert len({tuple(b) for b in got.values()}) == 5
    small = {r.id: r.bundle for r in sampling.bundles(rows, "id", "need", pool.limit(3), "doc", 8, seed=1).collect()}
    assert all(len(b) == 3 for b in small.values())


def test_audit_compiles_rules_by_what_they_need(spark):
    rows = spark.createDataFrame([(1, "a", [1, 9], None, 5), (2, "b", None, 1, 5), (2, "b", [], 1, 5), (3, None, [1], 7, 2), (4, "a", [9, 9], 1, 1)], "id int, k string, refs array<int>, link int, v int")
    rules = [
        checks.Row("has k", F.col("k").isNotNull()),
        checks.Unique("one id", ("id",)),
        checks.Unique("k and v", ("k", "v")),
        checks.Known("ref", F.col("refs"), "t"),
        checks.Known("link", F.array_compact(F.array("link")), "t"),
        checks.Pair("same v", "link", F.col("v") == F.col("other.v")),
    ]
    got = sorted(map(tuple, checks.audit(rows, "id", rules, {"t": spark.createDataFrame([(1,), (2,)], "key int")}).collect()))
    want = [(3, "has k"), (2, "one id"), (2, "one id"), (2, "k and v"), (2, "k and v"), (1, "ref"), (4, "ref"), (3, "link"), (3, "same v"), (4, "same v")]
    assert got == sorted(want)


def test_load_summary_of_gaps_single_rows_and_nothing(spark):
    schema = "layer string, seconds double, second int, ok boolean"
    rows = spark.createDataFrame([("a", 1.0, 0, True), ("a", None, 10, False), (None, 3.0, 5, True), ("b", None, 7, True)], schema).withColumn("at", F.timestamp_seconds("second"))
    got = {r.layer: (r.n, r.n_ok, r.wall, r.per_second, r.p50) for r in traffic.load_summary(rows, "layer", "seconds", "at", "ok", (50,)).collect()}
    assert got == {"a": (2, 1, 10.0, 0.1, 1.0), None: (1, 1, 0.0, None, 3.0), "b": (1, 1, 0.0, None, None), "all": (4, 3, 10.0, 0.3, 1.0)}
    assert traffic.load_summary(rows.limit(0), "layer", "seconds", "at", "ok", (50,)).count() == 0


def test_a_wrong_source_is_an_expected_hit_from_elsewhere(spark):
    rows = spark.createDataFrame([(True, True, 1, 1), (True, True, 2, 1), (True, False, 1, None), (False, True, None, 1), (False, False, None, None)], "hit boolean, due boolean, src int, want int")
    got = [r.o for r in rows.select(cache.exact_outcome(F.col("hit"), F.col("due"), F.col("src"), F.col("want")).alias("o")).collect()]
    assert got == ["true_hit", "wrong_source", "false_hit", "missed_hit", "true_miss"]


def test_totals_and_rows_before_keep_null_labels(spark):
    rows = spark.createDataFrame([(None, 1, 5), ("a", 2, 7), (None, 3, 2), ("a", 4, 1), (None, 5, 1)], "k string, i int, v int")
    for parts in (1, 3):
        assert sorted((r.i, r.total) for r in traffic.running_total(rows, ["k"], ["i"], F.col("v"), parts).collect()) == [(1, 5), (2, 7), (3, 7), (4, 8), (5, 8)]
        assert sorted((r.i, r.before) for r in traffic.previous(rows, ["k"], ["i"], "v", "before", parts).collect()) == [(1, None), (2, None), (3, 5), (4, 7), (5, 2)]
