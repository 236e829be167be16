"""Multi-label linear models against a slow solver, one label at a time."""

import collections
import math
import random
import re

import numpy as np
import pytest

from auditloom.operators import multilabel


def features(texts, stop, most):
    words = [[w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop] for t in texts]
    n = collections.Counter(w for ws in words for w in ws)
    vocabulary = sorted(n, key=lambda w: (-n[w], w))[:most]
    df = {w: sum(w in ws for ws in words) for w in vocabulary}
    x = np.array([[ws.count(w) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w in vocabulary] for ws in words]).reshape(len(texts), -1)
    return vocabulary, np.c_[x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12), np.ones(len(texts))]


def slow(kind, x, y, c):
    """Newton steps with halving."""
    def value(w):
        m = y * (x @ w)
        return w @ w / 2 + c * (np.logaddexp(0, -m) if kind == "logistic" else np.maximum(0, 1 - m) ** 2).sum()

    w = np.zeros(x.shape[1])
    for _ in range(200):
        m = y * (x @ w)
        if kind == "logistic":
            p = 1 / (1 + np.exp(m))
            g, h = w - c * x.T @ (y * p), np.eye(len(w)) + c * (x.T * (p * (1 - p))) @ x
        else:
            on = m < 1
            g, h = w - 2 * c * x.T @ (y * np.maximum(0, 1 - m)), np.eye(len(w)) + 2 * c * (x.T * on) @ x
        d = np.linalg.solve(h, g)
        t = 1.0
        while value(w - t * d) > value(w) - 1e-4 * t * (g @ d) and t > 1e-9:
            t /= 2
        w = w - t * d
        if np.abs(g).max() < 1e-9:
            break
    return w


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge"])
def test_matches_a_slow_solver(spark, monkeypatch, kind):
    monkeypatch.setattr(multilabel, "AT_ONCE", 3)  # several runs
    monkeypatch.setattr(multilabel, "BATCH", 7)
    rng = random.Random(1)
    pool = [f"word{i}" for i in range(40)] + ["the", "and", "x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(90)] + [None, "", "THE Word1 word1"]
    codes = {i: {k for k in "ABCDE" if rng.random() < 0.2 or f"word{ord(k) - 65} " in (t or "")} for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "note long, text string").repartition(3)
    labels = spark.createDataFrame([(i, c) for i, cs in codes.items() for c in cs] * 2 + [(999, "Z"), (1, None)], "note long, code string")
    m = multilabel.MultiLabelLinear(kind, features=30, c=2.0, tolerance=1e-6, iterations=300, stop={"the", "and"}).fit(docs, labels)
    vocabulary, x = features(texts, {"the", "and"}, 30)
    assert list(m.vocabulary) == vocabulary and m.codes == list("ABCDEZ")
    want = np.array([slow(kind, x, np.array([1.0 if c in codes[i] else -1.0 for i in range(len(texts))]), 2.0) for c in m.codes]).T
    assert np.abs(m.weights - want).max() < 1e-3
    z = x @ want
    z = 1 / (1 + np.exp(-z)) if kind == "logistic" else (z - z.min(1, keepdims=True)) / (z.max(1, keepdims=True) - z.min(1, keepdims=True))
    got = {(r.note, r.code): r for r in m.scores(docs).collect()}
    assert len(got) == len(texts) * 6
    assert max(abs(got[i, c].score - z[i, k]) for i in range(len(texts)) for k, c in enumerate(m.codes)) < 1e-3
    top = m.scores(docs, 2).collect()
    assert len(top) == 2 * len(texts) and all(got[r.note, r.code]["rank"] == r["rank"] for r in top)


def test_sparse_blocks(spark, monkeypatch):
    """A step's objective and gradient come from saved sparse blocks (notes without features and codes among them) and are those of the dense matrix."""
    monkeypatch.setattr(multilabel, "BLOCK", 3)
    monkeypatch.setattr(multilabel, "NUMBERS", 5)  # several cuts a block
    rng, x = np.random.default_rng(3), np.zeros((11, 9))
    rows, y = [], np.full((11, 2), -1.0)
    for r in range(11):
        i = np.sort(rng.choice(8, r % 4, replace=False)).astype(np.int32)
        v = rng.random(len(i)).astype(np.float32)
        own = [c for j, c in enumerate("AB") if (r >> j) % 3 == 0]
        x[r, i], x[r, 8], y[r, ["AB".index(c) for c in own]] = v, 1, 1
        rows.append((bytearray(i.tobytes()), bytearray(v.tobytes()), own))
    blocks = multilabel.MultiLabelLinear._blocks(spark.createDataFrame(rows, "idx binary, val binary, codes array<string>").coalesce(1), ["A", "B"])
    assert blocks.count() == 4
    for kind in ("logistic", "squared_hinge"):
        w = rng.normal(size=(9, 2))
        f, g = multilabel.MultiLabelLinear(kind, c=2.0)._evaluate(blocks, ["A", "B"], w)
        loss, slope = multilabel._loss(kind, x @ w, y)
        assert np.allclose(f, (w * w).sum(0) / 2 + 2 * loss.sum(0)) and np.allclose(g, w + 2 * x.T @ slope)


def test_learners_without_labels_or_notes(spark):
    docs = spark.createDataFrame([(1, "some words here")], "note long, text string")
    none = spark.createDataFrame([], "note long, code string")
    assert multilabel.MultiLabelLinear().fit(docs, none).scores(docs).collect() == []
    empty = multilabel.MultiLabelLinear().fit(docs.where("false"), spark.createDataFrame([(1, "A")], "note long, code string"))
    assert empty.scores(docs).first().score <= 0.5


def test_labels_of_documents(spark):
    from auditloom.queries import learned

    d = "/root/testdata/sf0.001"
    truth = {(r.note, r.code) for r in learned.codes(spark, d).collect()}
    for f in (learned.tfidf_lr, learned.tfidf_svm):
        first = f(spark, d).where("rank = 1").collect()
        assert len(first) > 15 and sum((r.note, r.code) in truth for r in first) >= 0.9 * len(first)
