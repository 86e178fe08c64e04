import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string, sequence_id long"


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")


def check(rows, pieces, encode, window):
    """Each id in one piece, gapless offsets, and sequences that are full or have a power of two of tokens."""
    ids = {i: encode(t) for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    copies = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    for i, v in ids.items():
        held = np.zeros(len(v), dtype=int)
        for start, n in by_doc[i]:
            held[start : start + n] += 1
        assert (held == copies[i]).all()
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)
    return by_sequence


@pytest.mark.parametrize(("window", "shard"), [(64, 5), (64, 2048), (4096, 2048)])
def test_odd_rows(spark, encode, window, shard):
    rows = [(1, None), (2, ""), (3, "Hello,  World\n\n it's 42!"), (4, "<|endoftext|>x <|startoftext|>"), (5, "é́  ß İ 😀\t\x0b" * 30), (6, "long words " * 9000), (7, "a" * 3000), (8, "same"), (8, "same"), (None, "no id")] + [(20 + i, f"text number {i} " * (i % 13)) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    check(rows, packing.pack(df, PATH, window=window, shard=shard).collect(), encode, window)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_neighbours_come_before_strangers():
    draw = np.random.default_rng(1)
    topics = [draw.integers(100 * t, 100 * t + 40, size=(6, 30)) for t in range(4)]
    fragments = [(i, 0, ids.astype(np.uint16), 30) for i, ids in enumerate(np.concatenate(topics)[[k * 6 + j for j in range(6) for k in range(4)]])]
    df = np.ones(500)
    for _, _, ids, _ in fragments:
        df[np.unique(ids)] += 1
    shard = packing.Shard(fragments, np.log1p((24 - df + 0.5) / (df + 0.5)), 30.0)
    windows = list(shard.windows(180))
    assert len(windows) == 4 and all({p[0] % 4 for p in w} == {w[0][0] % 4} for w in windows)


def test_scores_equal_plain_bm25():
    draw = np.random.default_rng(2)
    fragments = [(i, 0, draw.integers(0, 60, draw.integers(5, 50)).astype(np.uint16), 0) for i in range(40)]
    df = np.zeros(60)
    for _, _, ids, _ in fragments:
        df[np.unique(ids)] += 1
    idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), float(np.mean([len(f[2]) for f in fragments]))
    shard = packing.Shard(fragments, idf, mean)

    def score(seed, i):
        n = {t: int((fragments[i][2] == t).sum()) for t in shard.queries[seed]}
        return sum(idf[t] * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(fragments[i][2]) / mean)) for t, c in n.items() if c)

    for seed in range(10):
        wanted = sorted((i for i in range(40) if i != seed and score(seed, i) > 0), key=lambda i: (-round(score(seed, i), 9), i))
        assert [round(score(seed, i), 9) for i in shard.neighbours(seed)] == [round(score(seed, i), 9) for i in wanted]


def test_query_over_the_table(spark, sf_dir, encode):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, queries.op5_packing(spark, sf_dir).collect(), encode, 4096)


def test_a_fragment_is_found_by_its_whole_document_and_any_term():
    """Fragment 0's last tokens say nothing of its topic; fragment 1 shares only its 40th and lightest term with 2."""
    n = lambda terms: np.array(terms, dtype=np.uint16)
    topic = np.arange(100, 140)
    fragments = [(0, 64, n([1]), 65, (np.append(1, topic), np.append(1, np.full(40, 2)))), (1, 0, n([*range(200, 239), 50]), 40), (2, 0, n([50, *range(300, 320)]), 21), (3, 0, n(topic), 40)]
    idf = np.ones(400)
    idf[50] = 0.01
    shard = packing.Shard(fragments, idf, 40.0)
    assert shard.neighbours(3).tolist() == [0] and shard.neighbours(0).tolist() == [3]
    assert shard.neighbours(1).tolist() == [2]
    shard.take(3, 10)
    assert packing.Shard(shard.rest(), idf, 40.0).neighbours(3).tolist() == [0]


def test_documents_count_whole(spark, encode, monkeypatch):
    rows = [(1, "river " * 70 + "stone"), (2, "stone"), (3, "river")]
    told, made = [], packing._packed
    monkeypatch.setattr(packing, "_packed", lambda sent, *a: told.append(sent.value) or made(sent, *a))
    check(rows, packing.pack(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS), PATH, window=64).collect(), encode, 64)
    idf, mean_length, _ = told[0]
    ids = [encode(t) for _, t in rows]
    assert mean_length == np.mean([len(x) for x in ids])
    for term in set(np.concatenate(ids).tolist()):
        df = sum(term in x for x in ids)
        assert abs(idf[term] - np.log1p((3 - df + 0.5) / (df + 0.5))) < 1e-12
