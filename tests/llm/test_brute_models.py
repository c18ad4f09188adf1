"""The classifiers' scores by plain loops, their steps by exhaustive search and by differences of the likelihood."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest

from touchline.llm import quality, toxicity


def test_quality_scores_are_sums_of_table_entries():
    r = np.random.default_rng(1)
    x = np.column_stack([r.integers(0, 6, 400), r.standard_normal((400, 3)).round(1)])
    y = (x[:, 0] * 0.5 + x[:, 1] * x[:, 2] + 0.3 * r.standard_normal(400) > 1.5).astype(float)
    m = quality.boost(x, y, replace(quality.Settings(), rounds=12, pair_rounds=6, pairs=2, bins=16, leaf=5))
    assert m.pairs and any(np.abs(t).max() > 0 for t in m.tables)
    got = m.score(x)
    for row, value in zip(x, got, strict=True):
        at = [sum(e <= v for e in edges) for edges, v in zip(m.edges, row, strict=True)]  # the bin is the number of edges not above
        z = m.bias + sum(t[i] for t, i in zip(m.tables, at, strict=True)) + sum(t[m.coarse[j][at[j]]][m.coarse[k][at[k]]] for j, k, t in m.pairs)
        assert value == pytest.approx(1 / (1 + math.exp(-z)))
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss(got) < 0.6 * loss(np.full(len(y), y.mean()))


def test_quality_trees_equal_exhaustive_search():
    r = np.random.default_rng(2)

    def gain(g, h):
        return g.sum() ** 2 / (h.sum() + 1)

    def tree(g, h, n, leaf, depth):
        best = None
        if depth:
            for k in range(1, len(g)):
                if n[:k].sum() >= leaf and n[k:].sum() >= leaf:
                    v = gain(g[:k], h[:k]) + gain(g[k:], h[k:])
                    if v > gain(g, h) + 1e-9 and (best is None or v > best[0] + 1e-12):
                        best = (v, k)
        if best is None:
            return [g.sum() / (h.sum() + 1)] * len(g)
        k = best[1]
        return tree(g[:k], h[:k], n[:k], leaf, depth - 1) + tree(g[k:], h[k:], n[k:], leaf, depth - 1)

    for _ in range(200):
        size = r.integers(1, 12)
        g, n = r.standard_normal(size), r.integers(0, 30, size)
        h = n * r.uniform(0.05, 0.25, size)
        leaf = int(r.integers(1, 25))
        assert quality._steps(g, h, n, leaf, 2) == pytest.approx(tree(g, h, n, leaf, 2))


TEXTS = [None, "", "One. Two three! Four", "no end of it", "A\n\nb. c? d", 'He said "stop." Then left.', "x" * 5000, "bad word. " * 40, "ÉTÉ été. İstanbul!"]


def test_toxicity_is_the_noisy_or_of_sentences():
    s, r = toxicity.Settings(), random.Random(3)
    m = toxicity.Model(np.zeros(1 << s.bits, np.float32), -1.5)
    words = [w for t in TEXTS for w in (t or "").lower().split()]
    for w in words:
        for k in toxicity.features(w, s):
            m.weights[k] = r.uniform(-2, 2)
    for text, got in zip(TEXTS, toxicity.scores(m, s)(TEXTS), strict=True):
        chunks = (text or "").lower().replace("\n", " . ").split() or ["."]
        sentences, now = [], []
        for c in chunks:
            now.append(c)
            if c.rstrip("'\")]")[-1:] in (".", "!", "?"):
                sentences.append(now)
                now = []
        sentences += [now] if now else []
        clean, bad = 1.0, 0
        for words in sentences:
            z = m.bias + sum(round(sum(float(m.weights[k]) for k in toxicity.features(c, s) if k >= 0) * (1 << 20)) for c in words) / (1 << 20)
            p = 1 / (1 + math.exp(-min(max(z, -30), 30)))
            clean *= 1 - p
            bad += p >= s.threshold
        assert got[:3] == (pytest.approx(1 - clean, abs=1e-9), len(sentences), bad), text


def test_toxicity_steps_follow_the_likelihood(spark):
    """The first step goes down the slope that differences of the likelihood show, word by word."""
    r, s = random.Random(4), replace(toxicity.Settings(), steps=1, sparsity=0.0, least=1, openings=())
    vocabulary = [f"v{i}" for i in range(12)]
    docs = [(i, " ".join(r.choices(vocabulary, k=5)) + ". " + " ".join(r.choices(vocabulary, k=4)) + ".") for i in range(60)]
    truth = [(i, int("v0" in t.split() or r.random() < 0.2)) for i, t in docs]
    m = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, toxic int"), s, modulus=5, held=9)
    split = [[x.split() for x in t.rstrip(".").replace(".", " .").split(" . ")] for _, t in docs]

    def loss(w, b):
        out = 0.0
        for sentences, (_, y) in zip(split, truth, strict=True):
            clean = 1.0
            for words in sentences:
                clean *= 1 - 1 / (1 + math.exp(-(b + sum(w.get(x, 0.0) for x in words))))
            out -= math.log(1 - clean) if y else math.log(clean)
        return out / len(docs)

    for v in vocabulary:
        slope = (loss({v: 1e-5}, -5.0) - loss({v: -1e-5}, -5.0)) / 2e-5
        weight = float(m.weights[toxicity.features(v, s)[0]])
        assert weight == pytest.approx(-s.rate * slope / math.sqrt(1e-8 + slope**2), rel=1e-3), v
    slope = (loss({}, -5 + 1e-5) - loss({}, -5 - 1e-5)) / 2e-5
    assert m.bias == pytest.approx(-5.0 - s.rate * slope / math.sqrt(1e-8 + slope**2), rel=1e-3)
