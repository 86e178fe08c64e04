"""The router over whole texts and all vectors, against a plain fit."""

import re

import numpy as np

from tallyspark.functions import text
from tallyspark.plans import routing_queries


def write_tables(spark, folder, n=120, sources=6):
    """Documents of more than 400 characters whose features come after them, and vectors with gaps in their ids."""
    draw = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        quality = int(draw.random() < 0.5)
        body = "word " * 100 + "is it 7? " * int(draw.integers(0, 4) + 2 * (1 - quality)) + "yes. " * int(draw.integers(0, 9)) + ("right?" if draw.random() < 0.3 else "done.")
        docs.append((i, body, "en" if i % 3 else "de", f"src{i % sources}", len(body)))
        labels.append((i, quality, 0))
    vecs = [(7 * k + 3, [float(x) for x in draw.normal(size=3)]) for k in range(90)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("embeddings", vecs, "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, [q for _, q, _ in labels], [v for _, v in vecs]


def features(t, n_chars):
    count = lambda p: len(re.findall(p, t))
    return [len(t.split()), count(r"[.!?]+"), count(r"\?"), count(r"\d+"), count(rf"(?i)\b({'|'.join(text.CONNECTIVES)})\b"), int(t.lower().rstrip().endswith("right?")), 1, np.log1p(n_chars)]


def plain_fit(x, vec, y):
    """Newton's method on balanced log loss plus half the squared coefficients; returns a function of rows."""
    mean, dev = x.mean(0), x.std(0)
    dev[dev == 0] = 1
    wide = lambda a, v: np.hstack([v, (a - mean) / dev, np.ones((len(a), 1))])
    z, beta = wide(x, vec), np.zeros(vec.shape[1] + x.shape[1] + 1)
    weight, ridge = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())), np.diag([*np.ones(len(beta) - 1), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ beta)
    return lambda a, v: 1 / (1 + np.exp(-wide(a, v) @ beta))


def test_router_equals_a_plain_fit_over_whole_texts(spark, tmp_path):
    docs, quality, vecs = write_tables(spark, tmp_path)
    x, y = np.array([features(d[1], d[4]) for d in docs], dtype=float), 1.0 - np.array(quality)
    v = np.array([vecs[d[0] % len(vecs)] for d in docs], dtype=np.float32).astype(float)
    p = plain_fit(x[::2], v[::2], y[::2])(x[1::2], v[1::2])
    got = {(r.lang, r.quality): (r.n, r.mean_p) for r in routing_queries.router_logreg(spark, str(tmp_path)).collect()}
    odd = [(d[2], quality[d[0]]) for d in docs[1::2]]
    assert got.keys() == set(odd)
    for key, (n, mean_p) in got.items():
        own = [q for q, k in zip(p, odd, strict=True) if k == key]
        assert n == len(own) and abs(mean_p - np.mean(own)) < 0.002
