import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import anchors, queries

SCHEMA = "doc_id long, text string, kept string, d string"


def expected(docs, window):
    texts = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (name, _), w in zip(docs, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((name, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(spark, docs, window):
    found = anchors.remove_repeats(spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA), window).collect()
    for r in found:
        assert sum(s.end - s.begin for s in r.repeats) == r.n_removed and all(a.end < b.begin for a, b in zip(r.repeats, r.repeats[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr)


def test_runs_of_words_have_equal_hashes_only_where_equal():
    words = anchors.Words()
    a, b = words(["a b\tc d e", "x  a b  b c d\x0ce"])
    for size in (1, 2, 3, 5):
        for x, y in ((a, a), (b, b)):
            assert len(anchors.run_hashes(x, size)) == len(y) - size + 1
    assert anchors.run_hashes(a, 3)[2] == anchors.run_hashes(b, 3)[-1] and len(anchors.run_hashes(a, 6)) == 0


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_against_all_windows(spark, window):
    draw = random.Random(window)
    docs = []
    for i in range(60):
        docs.append((i, " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(0, 40)))))
    passage = " ".join(f"p{i}" for i in range(30))
    docs += [(100 + i, f"own{i} " * (i % 7) + passage + f" end{i}") for i in range(20)]
    docs += [(200, "x y z " * 30), (201, None), (202, ""), (None, "lone words here"), (None, " odd one \x0b two"), (203, "same text\nover again"), (203, "same text over again")]
    assert got(spark, docs, window) == expected(docs, window)


def test_copies_shifts_and_edges_of_windows(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(base)), (1, "more " + " ".join(base)), (1, "more " + " ".join(base)), (2, " ".join(base[:34])), (3, " ".join(base[50:85])), (4, " ".join(["q", *base[100:134], "r"]))]
    docs += [(5, "\n".join(["a", *(f"v{i}" for i in range(35)), "b", *(f"v{i}" for i in range(35)), "c"])), (6, "u " * 40_000), (7, "z" * 300_000 + " tail")]
    assert got(spark, docs, 35) == expected(docs, 35)


def test_crowded_buckets_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BUCKET_KEYS", 50)
    monkeypatch.setattr(anchors, "MAX_BROADCAST_ROWS", 0)
    docs = [(i, f"before{i} " * (i % 20) + " ".join(f"w{k}" for k in range(40)) + f" after{i}") for i in range(120)]
    assert got(spark, docs, 35) == expected(docs, 35)
    assert got(spark, [], 35) == []


def test_query_over_the_table(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op13_substring_dedup(spark, sf_dir)
    want = spark.createDataFrame(expected(docs, 35), "doc_id long, n_words long, n_removed long, kept string").withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
