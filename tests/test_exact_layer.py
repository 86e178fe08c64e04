"""The exact cache before the semantic one, in each mode; what is served writes to neither."""

import numpy as np
import pytest

from tallyspark.operators import signed
from tallyspark.plans import cache_queries
from tests.test_signed import MODES, SCHEMA

NAMES = ("context", "numbers", "negation")


def fold(rows, checked, least):
    """Plain Python: a row asks its tenant's exact cache, then the semantic one; a miss is written to both."""
    found, entries = [], []
    for seq, grp, v, *signs, key in sorted(rows):
        copy = next((s for s, g, _, _, k in entries if (g, k) == (grp, key)), None)
        near = [(-round(float(np.dot(v, w)), 6), s, t) for s, g, w, t, _ in entries if g == grp and round(float(np.dot(v, w)), 6) >= least]
        why = lambda t: next((f"{n}_mismatch" for n, a, b in zip(NAMES, signs, t, strict=True) if n in checked and a != b and (n == "context" or None not in (a, b))), None)
        served = min(((c, s) for c, s, t in near if not why(t)), default=None)
        close = min(near, default=None)
        if copy is not None:
            found.append((seq, True, copy, float("inf"), None))
        elif served:
            found.append((seq, True, served[1], -served[0], None))
        else:
            found.append((seq, False, None, -close[0] if close else None, "empty" if not found else why(close[2]) if close else "low_cosine"))
            entries.append((seq, grp, v, signs, key))
    return found


def drawn(n, seed, unknown):
    """Few keys, which name the signs, over vectors that mostly aren't near each other."""
    draw = np.random.default_rng(seed)
    pool = [(v / np.linalg.norm(v) * (0.3 if i % 6 == 5 else 1)).tolist() for i, v in enumerate(draw.normal(size=(n // 3, 5)))]
    rows = []
    for i in range(n):
        k = int(draw.integers(30))
        rows.append((int(3 * i - 40), int(draw.integers(2)), pool[draw.integers(len(pool))], "abc"[k % 3], None if unknown and k % 7 == 0 else str(k % 2), k % 5 % 2, f"k{k}"))
    return rows


@pytest.mark.parametrize(("block", "unknown"), [(65_536, False), (6, False), (65_536, True)])
def test_equals_the_fold_with_both_caches(spark, monkeypatch, block, unknown):
    monkeypatch.setattr(signed.entries, "__defaults__", (block,))
    rows, thresholds = drawn(140, 7, unknown), [0.4, 0.8]
    got = {}
    for r in signed.signed_replay(spark.createDataFrame(rows, SCHEMA + ", key string"), MODES, thresholds, exact="key").collect():
        got.setdefault((r.mode, r.threshold), []).append((r.seq, r.hit, r.served_from, r.cosine, r.miss_reason))
    assert got.keys() == {(m, t) for m in MODES for t in thresholds}
    for (mode, least), found in got.items():
        want = fold(rows, MODES[mode], least)
        assert sorted(found) == want and any(r[3] == float("inf") for r in want)
        assert any(r[1] and r[3] != float("inf") and any(o[:2] == (r[2], False) for o in want) for r in want)


def test_semantic_modes_asks_the_exact_cache_first(spark, tmp_path):
    """Vectors are the axes; document d has vector d % 6 and tenant 0 or, from vector 4 on, 1."""
    say = {0: "the same words", 1: "the same words", 4: "the same words", 6: "quite other words", 7: "quite other words", 8: "quite other words", 9: "quite other words"}
    docs = [(d, t, "en", "web") for d, t in say.items()]
    vecs = [(k, [float(i == k) for i in range(6)], k // 4) for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for r in cache_queries.semantic_modes(spark, str(tmp_path)).collect():
        # 0, 4 and 7 are misses. 1 is a copy of 0; 6 is near 0, so 7 meets no copy, nor 1, which wrote nothing; 8 and 9 are copies of 7.
        assert (r.queries, r.hits, r.exact_hits, r.correct_hit, r.wrong_hit) == (7, 4, 3, 3, 1)
        assert (r.missed_hit, r.true_miss, r.stopped_by_empty, r.stopped_by_low_cosine, r.tokens_saved) == (1, 2, 1, 2, 12)
