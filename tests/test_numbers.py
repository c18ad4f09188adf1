"""Numerical operators against closed forms, pandas and searches by brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.operators import causal, counts, evaluation, features, relational


def test_ewma_of_any_length(spark):
    rng = random.Random(1)
    rows = [(k, i, None if rng.random() < 0.2 or 300 < i < 1500 and k == 1 else rng.random() * 10) for k in (0, 1) for i in range(10_000)]
    rows += [(2, i, None) for i in range(5)] + [(3, 0, 7.0)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    for half_life in (1.0, 4.0, 8.0):
        got = features.ewma(df, "x", ["k"], ["i"], half_life, "e").orderBy("k", "i").toPandas()
        assert list(got.columns) == ["k", "i", "x", "e"]
        want = pd.DataFrame(rows, columns=["k", "i", "x"]).groupby("k").x.transform(lambda s: s.astype(float).ewm(halflife=half_life, adjust=True, ignore_na=False).mean())
        np.testing.assert_allclose(got.e.to_numpy(float), want.to_numpy(float), rtol=1e-9)


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 5000), "x": np.round(rng.standard_normal(5000), 2)})
    df = spark.createDataFrame([*pdf.itertuples(index=False, name=None), (9, 1.5), (8, None)], "g long, x double")
    shares = [0.0, 0.03, 0.25, 0.5, 0.97, 1.0]
    got = {r.g: list(r)[1:] for r in relational.quantiles(df, "x", shares, ("g",)).collect()}
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(part.x, shares))
    assert got[9] == [1.5] * 6 and 8 not in got
    whole = relational.quantiles(df, "x", shares).first()
    np.testing.assert_allclose(list(whole), np.quantile([*pdf.x, 1.5], shares))
    rows = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],), ([5.0],)], "a array<double>")
    got = rows.select([S.quantile(F.array_sort("a"), q) for q in (0.05, 0.5, 1.0)]).collect()
    np.testing.assert_allclose([list(r) for r in got], [np.quantile([1, 2, 3, 10], [0.05, 0.5, 1.0]), [5.0] * 3])


def test_temperature_inside_its_bounds(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((6000, 3)) * 1.5
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    q = p ** (1 / 1.7)
    q /= q.sum(1, keepdims=True)
    y = (rng.random(6000)[:, None] > q.cumsum(1)).sum(1).clip(0, 2)
    fold = np.arange(6000) % 3
    df = spark.createDataFrame(list(zip(fold.tolist(), p.tolist(), y.tolist(), strict=True)), "fold long, p array<double>, y int")
    got = {r.fold: r for r in evaluation.leave_one_out_temperature(df, "fold").collect()}

    def loss(t, k):
        s = p[fold != k] ** (1 / t)
        return -np.log(s[np.arange(len(s)), y[fold != k]] / s.sum(1)).mean()

    for k in range(3):
        best = evaluation.golden(lambda t: loss(t, k), 0.3, 3.0)
        assert abs(got[k].t - best) < 1e-4 and abs(got[k].log_loss - loss(best, k)) < 1e-7
    assert evaluation.leave_one_out_temperature(df.where("fold = 0"), "fold").count() == 0


def test_rho_fit(spark):
    rng = np.random.default_rng(4)
    lh, la = rng.uniform(0.8, 1.8, 4000), rng.uniform(0.6, 1.5, 4000)
    df = spark.createDataFrame(list(zip(lh.tolist(), la.tolist(), rng.poisson(lh).tolist(), rng.poisson(la).tolist(), strict=True)), "lh double, la double, hg int, ag int")
    rows = df.collect()

    def ll(rho):
        tau = {(0, 0): lambda r: 1 - r.lh * r.la * rho, (0, 1): lambda r: 1 + r.lh * rho, (1, 0): lambda r: 1 + r.la * rho, (1, 1): lambda r: 1 - rho}
        return sum(math.log(max(tau[r.hg, r.ag](r), 1e-12)) for r in rows if (r.hg, r.ag) in tau)

    low, high = counts.rho_bounds(df)
    best = evaluation.golden(lambda r: -ll(r), low, high)
    assert abs(counts.fit_rho(df) - best) < 1e-5
    assert counts.fit_rho(df.limit(0)) == 0.0


def _open(edges, path, given):
    """Whether a path of vertices is open given a set."""
    arrows = set(edges)
    for u, v, w in zip(path, path[1:], path[2:], strict=False):
        if (u, v) in arrows and (w, v) in arrows:
            below, grow = {v}, True
            while grow:
                more = {b for a, b in edges if a in below} - below
                below |= more
                grow = bool(more)
            if not below & given:
                return False
        elif v in given:
            return False
    return True


def _paths(edges, a, b):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
    work = [[a]]
    while work:
        p = work.pop()
        if p[-1] == b:
            yield p
            continue
        work += [[*p, n] for n in near.get(p[-1], ()) if n not in p]


def test_adjustment_sets():
    rng = random.Random(5)
    names = "abcde"
    for _ in range(120):
        edges = [e for e in itertools.combinations(names, 2) if rng.random() < 0.45]
        a, b = rng.sample(names, 2)
        rest = [n for n in names if n not in (a, b)]
        sets = [set(s) for n in range(4) for s in itertools.combinations(rest, n)]
        for s in sets:
            assert causal.separated(edges, a, b, s) == (not any(_open(edges, p, s) for p in _paths(edges, a, b)))
        below, grow = {a}, True
        while grow:
            more = {v for u, v in edges if u in below} - below
            below |= more
            grow = bool(more)
        arrows = set(edges)
        used = {v for e in edges for v in e}
        blocks = lambda s, x, y: not any((p[1], p[0]) in arrows and _open(edges, p, s) for p in _paths(edges, x, y))
        back = [s for s in sets if s <= used and not s & below and blocks(s, a, b)]
        assert causal.all_backdoor_sets(edges, a, b) == back
        assert causal.backdoor_sets(edges, a, b) == [s for s in back if not any(o < s for o in back)]
        through = lambda p, s: any(v in s for v in p[1:-1])
        directed = [p for p in _paths(edges, a, b) if all((u, v) in arrows for u, v in itertools.pairwise(p))]
        front = [
            s for s in sets
            if s and s <= used and all(through(p, s) for p in directed) and all(blocks(set(), a, m) for m in s) and all(blocks({a} | (s - {m}), m, b) for m in s)
        ]
        assert causal.frontdoor_sets(edges, a, b) == front, (edges, a, b)


def test_graph_text():
    assert causal.edges_of('digraph { a -> "b c" -> d; e\n a -> d }') == [("a", "b c"), ("b c", "d"), ("a", "d")]


def test_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 2)) * [1, 1e3] + [1e6, -4]
    y = 3 + x @ [2.0, -0.5] + rng.standard_normal(500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    got = {r.term: r for r in causal.regression(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(500), x - x.mean(0)])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rss[0] / 497 * np.diag(np.linalg.inv(design.T @ design)))
    np.testing.assert_allclose([got["a"].estimate, got["b"].estimate], beta[1:], rtol=1e-7)
    np.testing.assert_allclose([got["a"].se, got["b"].se], se[1:], rtol=1e-6)
    assert all(r.estimate is None for r in causal.regression(df.limit(0), "y", ["a"]).collect())
    twice = causal.regression(df.withColumn("c", F.col("a")), "y", ["a", "c"]).collect()
    assert all(r.se is None for r in twice) and twice[1].estimate == pytest.approx(twice[2].estimate, rel=1e-6)
    assert causal.independence(df.withColumn("u", F.rand(1)), "y", "u", ["a", "b"]).first().independent
    assert not causal.independence(df, "y", "a", ["b"]).first().independent


def test_propensity(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((800, 2))
    t = (rng.random(800) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.7])))).astype(int)
    df = spark.createDataFrame([(i, int(v), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(t, x, strict=True))], "id long, treated int, a double, b double")
    got = np.array([r.propensity for r in causal.propensity(df, ["a", "b"]).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    design, w = np.column_stack([np.ones(800), z]), np.zeros(3)
    for _ in range(50):  # Newton's steps of the penalised likelihood
        p = 1 / (1 + np.exp(-design @ w))
        g = design.T @ (p - t) + np.array([0, w[1], w[2]])
        h = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0, 1, 1])
        w -= np.linalg.solve(h, g)
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-design @ w)), atol=1e-4)
