import re
import zlib
from collections import Counter

import pytest

from tallyspark.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected(counts, ratio=5):
    found = {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        good = others and -others[0][0] >= ratio * n
        found[w] = (n, len(others), others[0][1] if good else None, -others[0][0] if good else None)
    out = {}
    for w, told in found.items():
        root = w
        while found[root][2]:
            root = found[root][2]
        out[w] = (*told, root)
    return out


def got(frame):
    rows = frame.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def counted(docs, changed=True):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if changed and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_bitsets_against_plain_edits():
    words = sorted({a + b + c for a in ("", "a", "ab", "ba", "aab") for b in ("", "a", "b", "ab") for c in ("", "a", "bb", "ba")} - {""})
    slices = spelling.Slices(words)
    for w in words:
        bits = slices.near(w)
        assert [v for i, v in enumerate(words) if bits >> i & 1] == [v for v in words if near(w, v)]
        bits = slices.near(w, 1)
        assert [v for i, v in enumerate(words) if bits >> i & 1] == [v for v in words if near(w, v) and v[0] != w[0]]


@pytest.mark.parametrize("block", [4096, 7])
def test_forms_roots_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    stem = [p + "xxx" + s for p in ("abc", "abd", "abcd", "bc", "éßc", "z") for s in ("fgh", "fgi", "fg", "gfgh", "øgh")]
    counts = {w: 5 ** (i % 5 + 1) for i, w in enumerate(stem) if len(w) >= 6}
    counts |= {"banana": 625, "bananas": 125, "bananass": 25, "bananasss": 5, "cabana": 625, "canana": 625, "bananà": 125, "q" * 500: 9, "q" * 501: 60}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(df)) == expected(counts)


def test_short_words(spark):
    counts = {"a": 100, "b": 5, "ab": 9, "ba": 100, "abc": 1}
    assert got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), min_length=1)) == expected(counts)


def test_whole_texts_nulls_repeats_and_empty_tables(spark):
    docs = [(1, "Straße STRASSE straße " * 5), (2, None), (3, ""), (None, "Élan-vital élan_vital×÷ don't " * 7), (1, "Straße STRASSE straße " * 5), (4, "letter " * 30_000 + "lettre"), (4, "leter ltter lettter " * 6)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    assert got(spelling.variants(spelling.word_counts(df))) == expected(counted(docs, changed=False))
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_query_over_the_table(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(queries.op11_spelling(spark, sf_dir))
    assert found == expected(counted(docs)) and any(r[2] for r in found.values())
