"""What the classifiers see, against plain definitions, and the order that calibration keeps."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality, textstats, toxicity

ALPHABET = ["you", "your", "idiot", "zorkly", "zorks", "calm", "River", "LOUD", "1d10t", "i.d.i.o.t", "é", "tu", "!", "?", "...", "|", "#", "\n", "42", "a"]


def texts(n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choices(ALPHABET, k=draw.randint(0, 40))) for _ in range(n)]


def plain_weight(word, terms):
    if word in terms:
        return terms[word]
    return next((terms[word[:k] + "*"] for k in (8, 7, 6, 5, 4) if len(word) >= k and word[:k] + "*" in terms), 0.0)


def test_toxicity_features_equal_plain_ones():
    terms = {"idiot": 5.0, "zork*": 3.0, "zorkl*": 4.0}
    for text in [*texts(120, 1), "", "!!!", "idiot " * 50]:
        words = re.findall(r"\w+", text.lower())
        weights = [plain_weight(w, terms) for w in words]
        hits = [i for i, w in enumerate(weights) if w]
        second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
        gaps = [abs(i - j) for i in hits for j in second if 1 <= abs(i - j) <= toxicity.NEAR]
        masked = toxicity.MIXED.findall(text.lower()) + toxicity.SPELT.findall(text.lower())
        plain = [m.translate(toxicity.LEET) for m in masked]
        ascii_ = [c for c in text if c < "\x80"]
        upper, lower = (sum(getattr(c, f)() for c in ascii_) for f in ("isupper", "islower"))
        n, m = max(1, len(text)), max(1, len(words))
        want = [
            len(hits) / m,
            min(len(hits), 8),
            min(sum(weights), 40.0),
            min(sum(plain_weight(p, terms) > 0 for p in plain if p), 5),
            1 / min(gaps) if gaps else 0.0,
            upper / max(1, upper + lower),
            text.count("!") / n,
            text.count("?") / n,
            sum(not c.isalnum() and "!" <= c <= "~" for c in text) / n,
            sum(c.isdigit() for c in ascii_) / n,
            len(masked) / m,
            math.log1p(len(words)),
        ]
        assert toxicity.features(text, toxicity.Lexicon(terms)) == pytest.approx(want), text


def test_text_statistics_equal_plain_ones():
    for text in [*texts(120, 2), "", "\n\n", "one line only"]:
        got = dict(zip(textstats.TEXT_STATS, textstats.text_stats(text), strict=True))
        words, lines, n = re.findall(r"\w+", text.lower()), [x for x in text.split("\n") if x], len(text)
        if not n:
            assert set(got.values()) == {0.0}
            continue
        triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
        assert got["log_chars"] == pytest.approx(math.log1p(n)) and got["distinct_words"] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert got["distinct_trigrams"] == pytest.approx(len(triples) / max(1, len(words) - 2)) and got["distinct_lines"] == pytest.approx(len(set(lines)) / max(1, len(lines)))
        assert got["word_len"] == pytest.approx(sum(map(len, words)) / max(1, len(words))) and got["short_words"] == pytest.approx(sum(len(w) < 4 for w in words) / max(1, len(words)))
        assert got["wide"] == pytest.approx(sum(b >= 128 for b in text.encode()) / n) and got["stops"] == pytest.approx(sum(text.count(c) for c in ".!?") / max(1, len(words)))
        assert got["upper"] == pytest.approx(sum("A" <= c <= "Z" for c in text) / n) and got["bar"] == pytest.approx(text.count("|") / n)


def test_lexicon_equals_plain_counts(spark):
    draw = random.Random(3)
    rows = [(" ".join(draw.choices(["zorkly", "zorkish", "calm", "river", "fool"] if toxic else ["calm", "river", "tree", "fool"], k=6)), toxic) for toxic in (0, 1) for _ in range(60)]
    got = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"), least=4, ratio=12.0, most=100)
    seen = {y: Counter(t for text, toxic in rows if toxic == y for t in toxicity.terms_of(text)) for y in (0, 1)}
    want = {}
    for t, a in seen[1].items():
        b, w = seen[0][t], math.log((a + 0.5) / 61) - math.log((seen[0][t] + 0.5) / 61)
        if a >= 4 and w >= math.log(12.0) and a - (b + 1) >= 3 * math.sqrt(b + 1):
            want[t] = w
    assert got == pytest.approx(want) and "zork*" in got and "calm" not in got


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


def test_scores_keep_the_order_of_the_trees(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", "text", F.lit(0).alias("part"))
    raw = {r.doc_id: r.raw for r in toxicity._raw(model.trees, toxicity._featured(rows, [model.lexicon])).collect()}
    scores = {r.doc_id: (r.score, r.predicted) for r in model.score(docs).collect()}
    order = sorted(scores, key=lambda i: raw[i])
    assert all(scores[a][0] <= scores[b][0] + 1e-12 for a, b in zip(order, order[1:], strict=False))
    assert all(p == int(s >= 0.5) for s, p in scores.values())
    # Whatever else a row says, its text alone decides.
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1))
    assert {r.doc_id: (r.score, r.predicted) for r in model.score(other).collect()} == scores


def test_views_are_combined_by_their_odds(spark, tables):
    docs, labels = tables
    rows = quality.score_documents(docs, labels).collect()
    base = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where(~toxicity.held_out(F.col("doc_id"))).agg(F.avg("q")).first()[0]
    logit = lambda p: math.log(p / (1 - p))
    held = lambda p: min(max(p, quality.EDGE), 1 - quality.EDGE)
    for r in rows:
        odds = logit(held(r.text_score)) + logit(held(r.meta_score)) - logit(held(base))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds))) and r.keep == (r.score >= 0.5)
