"""Evaluations of configurations against plain Python, and the router's out-of-fold probabilities against a plain fit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evaluation, routing
from tallyspark.plans import routing_queries
from tests.test_routing import features, plain_fit, write_tables

CHUNKS = "req_id long, doc_id long, pos int, section string, tokens int, score double, holds array<int>, bare_tokens int, bare_holds array<int>"


def plain_window(rows, c):
    """(used, documents, facts) of one request by the definition of each approach."""
    by = lambda r: (-r["score"], r["pos"])
    docs = sorted({r["doc_id"] for r in rows})
    own = {d: [r["score"] for r in rows if r["doc_id"] == d] for d in docs}
    first = {d: min(r["pos"] for r in rows if r["doc_id"] == d) for d in docs}
    value = {d: max(v) if c.method != "mean" else round(sum(round(x * 1e6) for x in v)) / len(v) / 1e6 for d, v in own.items()}
    ranked = sorted(docs, key=lambda d: (-value[d], first[d]))
    used, kept = 0, []
    if c.approach == "section_first":
        for r in sorted((r for r in rows if r["section"] != "repeated_reminders"), key=by):
            if not kept or used + r["tokens"] <= c.budget:
                kept.append((r["doc_id"], r["holds"]))
                used += r["tokens"]
    else:
        bare = sorted((r for r in rows if r["bare_tokens"] is not None), key=by)
        whole = {ranked[0]} if c.approach == "hybrid" else {d for d in ranked[: evaluation.MAX_DOCS] if -value[d] <= -value[ranked[0]] + c.gap}
        for r in bare:
            if r["doc_id"] in whole:
                kept.append((r["doc_id"], r["bare_holds"]))
                used += r["bare_tokens"]
        for r in bare if c.approach == "hybrid" else ():
            if r["doc_id"] not in whole and used + r["bare_tokens"] <= c.budget:
                kept.append((r["doc_id"], r["bare_holds"]))
                used += r["bare_tokens"]
    return used, {d for d, _ in kept}, {f for _, h in kept for f in h}


def test_windows_equal_the_plain_definition(spark):
    draw = np.random.default_rng(2)
    rows = []
    for req in range(12):
        for pos in range(int(draw.integers(4, 30))):
            holds = [int(k) for k in range(1, 4) if draw.random() < 0.15]
            bare = None if draw.random() < 0.1 else int(draw.integers(5, 250))
            rows.append(dict(req_id=req, doc_id=req * 10 + int(pos // 5), pos=pos, section="repeated_reminders" if pos % 7 == 6 else "s", tokens=int(draw.integers(20, 400)), score=float(round(draw.integers(-8, 9) / 8, 6)), holds=holds, bare_tokens=bare, bare_holds=holds[:1]))
    gold = [(r, f"c{r % 4}", r * 10 + 2, 3) for r in range(12)]
    got = evaluation.window_results(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(gold, "req_id long, cluster_id string, gold_doc long, n_facts int"), least_tokens=0).collect()
    assert len(evaluation.WINDOWS) == 29 and len(got) == 12 * 29
    for r in got:
        used, docs, facts = plain_window([x for x in rows if x["req_id"] == r.req_id], evaluation.WINDOWS[r.place])
        assert (r.after, r.docs_kept, r.all_facts, r.gold_kept) == (used, len(docs), len(facts) == 3, r.req_id * 10 + 2 in docs), r


def test_splits_halve_clusters_for_each_seed(spark):
    names = [f"c{i}" for i in range(9)]
    got = evaluation.splits(spark.createDataFrame([(n,) for n in names * 3], "cluster_id string"), seeds=3).collect()
    for seed in range(3):
        train = {r.cluster_id for r in got if r.seed == seed and r.split == "train"}
        assert train == set(sorted(names, key=lambda n: hashlib.sha256(f"{seed}:{n}".encode()).hexdigest())[:4])
    assert len(got) == 27


def test_cost_summary_counts_only_numbers_and_pays_the_judge_once(spark):
    schema = "pipeline string, layer string, model string, cost_usd double, verdict string, score string, input_tokens long"
    rows = [("baseline", "llm", "large", 0.5, "correct", "1", 100), ("baseline", "llm", "large", 0.25, "wrong", "none", 50), ("v", "llm", "small", 0.1, "partial", "0.5", 10), ("v", "exact_cache", None, 0.0, "odd", "", 0)]
    got = {r.pipeline: r for r in evaluation.cost_summary(spark.createDataFrame(rows, schema), 0.05).collect()}
    b, v = got["baseline"], got["v"]
    assert (b.cost_usd, b.per_1k, b.vs_base, b.correct, b.wrong, b.mean_score, b.unparsed) == (0.75, 375.0, 1.0, 0.5, 0.5, 1.0, 0)
    assert (v.cost_usd, v.vs_base, v.partial, v.unparsed, v.mean_score, v.cached, v.small, v.input_tokens) == (pytest.approx(0.15), pytest.approx(0.2), 0.5, 1, 0.5, 1, 1, 10)


def test_out_of_fold_probabilities_equal_plain_fits(spark, tmp_path):
    docs, quality, vecs = write_tables(spark, tmp_path)
    rows = routing_queries.router_rows(spark, str(tmp_path))
    got = {r.doc_id: (r.fold, r.p_large) for r in routing.out_of_fold(rows, "source", "embedding", "needs_large", folds=3).collect()}
    assert got.keys() == {d[0] for d in docs}
    # Whole sources go to folds, of equal sizes here.
    folds = {d[3]: got[d[0]][0] for d in docs}
    assert all(got[d[0]][0] == folds[d[3]] for d in docs) and sorted(folds.values()) == [0, 0, 1, 1, 2, 2]
    x, y = np.array([features(d[1], d[4]) for d in docs], dtype=float), 1.0 - np.array(quality)
    v = np.array([vecs[d[0] % len(vecs)] for d in docs], dtype=np.float32).astype(float)
    at = np.array([got[d[0]][0] for d in docs])
    for fold in range(3):
        p = plain_fit(x[at != fold], v[at != fold], y[at != fold])(x[at == fold], v[at == fold])
        assert np.allclose(p, [got[d[0]][1] for d in docs if got[d[0]][0] == fold], atol=0.003)


def test_a_saved_router_says_the_same(spark, tmp_path):
    write_tables(spark, tmp_path)
    rows = routing_queries.router_rows(spark, str(tmp_path))
    path = f"{tmp_path}/router"
    first = routing.load_or_fit(spark, path, rows, "embedding", "needs_large")
    again = routing.load_or_fit(spark, path, rows.limit(0), "embedding", "needs_large")
    a, b = (sorted((r.doc_id, r.p_large) for r in router(rows).select("doc_id", "p_large").collect()) for router in (first, again))
    assert a == b


def test_strategies_use_the_safe_threshold(spark, tmp_path):
    write_tables(spark, tmp_path)
    rows = routing_queries.router_rows(spark, str(tmp_path))
    train, test = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    got = {r.strategy: r for r in routing.compare_strategies(train, test, "source", "embedding", "needs_large", 0.2).collect()}
    assert got.keys() == {"router", "rules", "always_large", "always_small", "labels"}
    told = [(r.needs_large == 1, r.p_large) for r in routing.out_of_fold(train, "source", "embedding", "needs_large").collect()]
    rate = lambda t: sum(c and p < t for c, p in told) / max(1, sum(c for c, _ in told))
    threshold = max((t for t in (round(0.05 * i, 2) for i in range(1, 20)) if rate(t) <= 0.2), default=0.05)
    assert got["router"].threshold == threshold and got["rules"].threshold is None
    scored = [(r.needs_large == 1, r.p_large >= threshold) for r in routing.fit_router(train, "embedding", "needs_large")(test).collect()]
    assert got["router"].complex_to_small == round(sum(c and not big for c, big in scored) / sum(c for c, _ in scored), 4)
    assert got["always_large"].complex_to_small == got["labels"].complex_to_small == got["labels"].easy_to_large == 0 and got["always_small"].complex_to_small == 1
    assert got["always_small"].per_1k < got["always_large"].per_1k


def test_labelled_pairs_leave_out_unknown_rows(spark):
    rows = [("a", "qa", "cold", None, None), ("b", "qb", "semantic_hit", "a", None), ("c", "qc", "miss", "a", "b"), ("d", "qd", "miss", None, "gone"), ("e", "qe", "exact_hit", "a", "a")]
    got = evaluation.labelled_pairs(spark.createDataFrame(rows, "id string, query string, expected_cache string, semantic_of string, confusable_with string"))
    assert sorted(tuple(r) for r in got.collect()) == [("b", "paraphrase", "a", "qb", "qa"), ("c", "trap", "b", "qc", "qb")]
    assert got.where(F.lit(False)).count() == 0
