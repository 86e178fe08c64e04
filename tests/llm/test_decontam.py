import re

import numpy as np

from tallyspark.llm import decontam, queries
from tallyspark.llm.decontam import GAP, LEAST_SCORE, MATCH, MISMATCH, align

DOCS, ITEMS = "doc_id long, text string, item_id string, score double", "item_id long, text string, doc_id string"


def slow_score(a, b):
    table, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (MATCH if x == y else MISMATCH), table[i - 1][j] - GAP, table[i][j - 1] - GAP)
            best = max(best, table[i][j])
    return best / (MATCH * len(a))


def test_alignment_equals_the_plain_table():
    draw = np.random.default_rng(0)
    for _ in range(60):
        a, b = (draw.integers(0, 6, draw.integers(3, 25)).astype(np.uint64) for _ in range(2))
        score, begin, end = align(a, b)
        assert abs(score - slow_score(a, b)) < 1e-9
        if score:
            assert abs(slow_score(a, b[begin : end + 1]) - score) < 1e-9


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(docs, items):
    """Every document against every item that shares three words in a row with it."""
    out = set()
    for d, t in docs:
        w = words(t)
        grams = set(zip(w, w[1:], w[2:], strict=False))
        for i, x in items:
            v = words(x)
            if grams & set(zip(v, v[1:], v[2:], strict=False)) and slow_score(v, w) >= LEAST_SCORE:
                out.add((d, i))
    return out


def test_exact_edited_and_repeated_passages(spark):
    draw = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(vocab, 30))) for i in range(8)]
    docs = []
    for i, text in items:
        noise = lambda n: " ".join(draw.choice(vocab, n))
        w = text.split()
        edited = [x if k % 6 else "swapped" for k, x in enumerate(w)]
        docs += [(10 * i, f"{noise(40)}. {text}! {noise(900)}"), (10 * i + 1, f"{noise(15)} {' '.join(edited)} {noise(15)}"), (10 * i + 2, f"{noise(30)} {' '.join(w[:9] + w[11:20] + ['x', 'y'] + w[20:])}"), (10 * i + 3, noise(300)), (10 * i + 4, " ".join(w[:6]) + " " + noise(60))]
    docs += [(900, " ".join(items[0][1] for _ in range(3))), (901, None), (902, ""), (903, "two words")]
    df, bench = spark.createDataFrame([(*r, "clash", 1.0) for r in docs], DOCS), spark.createDataFrame([(*r, "clash") for r in items + [(99, None), (98, ""), (97, "two words"), (None, items[0][1])]], ITEMS)
    for block in (4_000_000, 60):
        got = decontam.find_leaks(df, bench, block_words=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert pairs == brute(docs, items) and len(got) == len(pairs)
        assert {(10 * i + k, i) for i in range(8) for k in range(3)} <= pairs
    assert next(r.score for r in got if (r.doc_id, r.item_id) == (0, 0)) == 1.0


def test_a_passage_in_most_documents_is_still_found(spark):
    item = " ".join(f"common{i}" for i in range(20))
    docs = [(i, f"start{i} {item} end{i}") for i in range(200)] + [(1000, "nothing of it")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(200))


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None)], DOCS)
    bench = spark.createDataFrame([(1, "a b c d e f", None), (1, "a b c d e f", None)], ITEMS)
    assert sorted(str(r.doc_id) for r in decontam.find_leaks(docs, bench).collect()) == ["1", "None"]
    assert decontam.find_leaks(docs.limit(0), bench).count() == decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_query_over_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in queries.op6_decontamination(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    assert exact <= got.keys()
    for (d, i), score in list(got.items())[:20]:
        assert abs(slow_score(words(dict(items)[i]), words(dict(docs)[d])) - score) < 1e-9


def test_edited_and_partial_copies_that_stand_alone(spark):
    """Each copy is the only one of its item; scores are from 0.45 up, some without three words in a row."""
    draw = np.random.default_rng(11)
    fresh = iter(range(10**6))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate([40, 38, 25, 12, 40, 40, 40, 40, 3, 40, 20])]
    cut = lambda w, step: " ".join(f"new{next(fresh)}" if k % step == step - 1 else x for k, x in enumerate(w))
    w = [x.split() for _, x in items]
    copies = [cut(w[0], 5), cut(w[1], 4), cut(w[2], 3), cut(w[3], 3), " ".join(w[4][:20]), " ".join(w[5][20:]), cut(w[6], 6)]
    copies.append(" ".join(f"{x} new{next(fresh)}" for x in w[7]))  # a word between any two: more than twice as long
    copies.append(f"{w[8][0]} other {w[8][2]}")
    copies.append(" ".join(x for k, x in enumerate(w[9]) if k % 3))  # a third left out
    copies.append(" ".join(f"new{next(fresh)}" if draw.random() < 0.25 else x for x in w[10]))
    docs = [(i, " ".join(f"d{i}n{k}" for k in range(60)) + f" {c} " + " ".join(f"d{i}m{k}" for k in range(60))) for i, c in enumerate(copies)]
    expected = {i: slow_score(w[i], words(t)) for i, t in docs}
    assert min(expected.values()) >= LEAST_SCORE
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == {(i, i): round(x, 9) for i, x in expected.items()}


def test_passages_hold_every_alignment_at_the_threshold():
    draw = np.random.default_rng(3)
    for _ in range(400):
        n, vocab = int(draw.integers(3, 14)), int(draw.integers(3, 12))
        item, doc = [" ".join(f"w{x}" for x in draw.integers(0, vocab, m)) for m in (n, int(draw.integers(2, 40)))]
        found = decontam.Items([(1, item)])
        hashed = decontam.hashed_words(doc, decontam.WordHashes())
        score = max((align(found.items[0][1], hashed[a:b])[0] for _, a, b in found.passages(hashed)), default=0)
        true = slow_score(words(item), words(doc))
        assert abs(score - true) < 1e-9 if true >= LEAST_SCORE else score < LEAST_SCORE


def test_seeds_leave_out_no_more_than_an_alignment_can_miss():
    draw = np.random.default_rng(12)
    for _ in range(100):
        texts = [" ".join(f"w{x}" for x in draw.integers(0, 9, int(draw.integers(3, 40)))) for _ in range(6)]
        items = decontam.Items(list(enumerate(texts)))
        for k, (_, w) in enumerate(items.items):
            own = np.unique(decontam.pairs(w[:-1], w[1:]))
            seeds = items.seeds[np.searchsorted(items.grams.known, own)].sum()
            repeats = len(w) - 1 - len(own)
            assert seeds >= 1 and len(own) - seeds <= max(0, int(items.least[k]) - 1 - repeats)


def test_a_very_long_text_and_tied_scores(spark):
    item = " ".join(f"i{k}" for k in range(20))
    noise = " ".join(f"n{k % 5000}" for k in range(120_000))
    docs = [(1, f"{noise} {item} {noise} {item}"), (2, noise)]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item), (6, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.first_word) for r in got) == [(1, 5, 1.0, 120_000), (1, 6, 1.0, 120_000)]


def test_clean_rows_are_those_without_leaks(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    gone = {r.doc_id for r in decontam.find_leaks(docs, items).collect()}
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - gone
