import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import ngram_join, queries

DOCS = "doc_id long, text string, key string, band long"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links) of each row, by comparing all rows."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(map(str, ((d, name[find(i)], links[i]) for i, (d, _) in enumerate(rows))))


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    return sorted(str((r.doc_id, r.class_id, r.n_links)) for r in ngram_join.classes(df).collect())


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "!!"), (4, "Four words are here"), (5, "four words ARE here"), (6, long), (7, long + " tail"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text without any copy")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_near_copies_chains_and_small_groups(spark):
    draw, rows = np.random.default_rng(1), []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(8):
            copy = list(words)
            for at in draw.integers(0, 120, draw.integers(0, 7)):
                copy[at] = f"edit{draw.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    for step in range(25):  # each is like the next, not like the one after many
        rows.append((len(rows), " ".join(f"c{i}" for i in range(step * 6, step * 6 + 150))))
    assert found(spark, rows) == brute(rows)


def test_a_large_group_goes_through_chunks(spark):
    """Hundreds of near copies: more than a bucket that is joined pair by pair, and more than one chunk."""
    draw, words = np.random.default_rng(2), [f"h{i}" for i in range(90)]
    rows = []
    for i in range(620):
        copy = list(words)
        for at in draw.integers(0, 90, i % 4):
            copy[at] = f"edit{draw.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows) == brute(rows)


def test_a_large_group_of_many_sizes(spark):
    """Chunks keep to a class of sizes: prefixes of one text, each similar to those within a quarter of its length."""
    words = [f"s{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 40 + i])) for i in range(0, 360, 2)]
    assert found(spark, rows) == brute(rows)


def test_similar_sizes_are_in_neighbouring_classes(spark):
    n = np.unique(np.concatenate([np.arange(1, 3000), np.arange(1, 400) * 1000]))
    made = spark.createDataFrame([(int(x), int(y)) for x in n for y in (x, x * 5 // 4)], "a long, b long")
    gaps = made.select((ngram_join.size_class(F.col("b")) - ngram_join.size_class(F.col("a"))).alias("gap"))
    assert {r.gap for r in gaps.distinct().collect()} <= {0, 1}


def test_roots_of_links():
    draw = np.random.default_rng(8)
    for n in (1, 7, 90):
        root, plain = np.arange(n), list(range(n))
        for _ in range(4):
            a, b = draw.integers(0, n, n // 3), draw.integers(0, n, n // 3)
            root = ngram_join._united(root, a, b)
            for x, y in zip(a, b, strict=True):
                old, new = max(plain[x], plain[y]), min(plain[x], plain[y])
                plain = [new if r == old else r for r in plain]
            assert root.tolist() == plain


def test_pruning_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(4)
    n = ngram_join.BANDS * ngram_join.ROWS
    a = draw.integers(0, 2**32, size=(4000, n), dtype=np.uint32)
    same = draw.random((4000, n)) < 0.8
    b = np.where(same, a, a + np.uint32(1))
    assert len(ngram_join.survivors(a, b)) == 4000
    b = np.where(draw.random((4000, n)) < 0.3, a, a + np.uint32(1))
    assert len(ngram_join.survivors(a, b)) < 10


def test_query_over_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(str((r.doc_id, r.class_id, r.n_links)) for r in queries.op9_ngram_join(spark, sf_dir).collect())
    assert got == brute(rows)
