"""Correlations, robust regression and leave-one-out densities against plain numpy and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest

from touchline.operators import association as A
from touchline.operators import causal, loo


def test_correlations_with_gaps(spark):
    r = np.random.default_rng(1)
    n = 2000
    x = r.standard_normal((n, 5)) * [1, 10, 1e-3, 5, 1] + [1e6, 0, 5, -3, 2]
    x[:, 3] += 2 * x[:, 1]
    x[:, 4] = 7.0  # no spread
    gap = r.random((n, 5)) < 0.2
    g = np.where(r.random(n) < 0.6, 0, r.integers(1, 5, n))
    rows = [(int(g[i]), [None if gap[i, j] else float(x[i, j]) for j in range(5)]) for i in range(n)] + [(9, [1.0] * 5), (8, [None] * 5), (8, None)]
    df = spark.createDataFrame(rows, "g long, x array<double>").repartition(5)
    got = {(p.g, p.i, p.j): p for p in A.correlations(df, "x", ("g",), block=100).collect()}
    for k in range(5):
        want = pd.DataFrame(np.where(gap, np.nan, x)[g == k]).corr().to_numpy()
        for i in range(5):
            for j in range(i + 1, 5):
                p = got[k, i, j]
                assert p.n == (~gap[g == k, i] & ~gap[g == k, j]).sum()
                assert p["corr"] is None if j == 4 else p["corr"] == pytest.approx(want[i, j], abs=1e-6)
    assert got[9, 0, 1]["corr"] is None and got[9, 0, 1].n == 1 and got[8, 0, 1].n == 0
    best = {p.g: (p.i, p.j) for p in A.top_pair(A.correlations(df, "x", ("g",)), "g").collect()}
    assert best[0] == (1, 3) and 9 not in best
    wide = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, float("nan"))], "a double, b double")
    assert [tuple(p) for p in A.correlations(wide, ["a", "b"]).collect()] == [(0, 1, 2, -1.0)]
    assert A.correlations(wide.limit(0), ["a", "b"]).collect() == []


def local_t(x, y, v, steps=3000):
    z = np.column_stack([np.ones(len(y)), x])
    b, s = np.linalg.lstsq(z, y, rcond=None)[0], y.var()
    for _ in range(steps):
        w = (v + 1) / (v + (y - z @ b) ** 2 / s)
        b = np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T @ y)
        s = (w * (y - z @ b) ** 2).mean()
    return b, math.sqrt(s)


def test_robust_regression(spark):
    r = np.random.default_rng(3)
    n = 1500
    x = r.standard_normal((n, 2)) * [1, 100] + [50, 1e4]
    y = 3 + x @ [2.0, -0.01] + r.standard_t(3, n)
    y[:40] += 500  # planted
    df = spark.createDataFrame([(float(c), float(a), float(b)) for c, (a, b) in zip(y, x, strict=True)] + [(None, 1.0, 1.0)], "y double, a double, b double")
    fit = causal.student_t(df, "y", ["a", "b"])
    b, s = local_t(x, y, 4.0)
    assert fit.estimates == pytest.approx(b, rel=1e-6) and fit.scale == pytest.approx(s, rel=1e-6) and fit.steps < 100
    plain = {t.term: t.estimate for t in causal.regression(df, "y", ["a", "b"]).collect()}
    assert abs(fit.estimates[1] - 2) < 0.15 < abs(plain["intercept"] - 3)
    few = causal.student_t(df, "y", ["a", "b"], freedom=(1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0))

    def likelihood(v):
        b, s = local_t(x, y, v, 600)
        z = (y - np.column_stack([np.ones(n), x]) @ b) ** 2 / s**2
        return n * (math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - math.log(v * math.pi) / 2 - math.log(s)) - (v + 1) / 2 * np.log1p(z / v).sum()

    assert few.freedom == max((1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0), key=likelihood)
    b, _ = local_t(x, y, few.freedom)
    assert few.estimates == pytest.approx(b, rel=1e-5)
    assert causal.student_t(df.limit(0), "y", ["a"]) is None and causal.robust_regression(df.limit(0), "y", ["a"]).collect() == []
    told = causal.independence(df, "y", "a", ["b"], robust=True).first()
    assert told.low < 2 < told.high and not told.independent


def test_pareto_fit_finds_the_shape():
    r = np.random.default_rng(4)
    for k, scale in ((0.2, 1.0), (0.5, 3.0), (0.9, 0.1), (-0.3, 2.0)):
        u = r.random((5, 20_000))
        x = np.sort(scale * np.expm1(-k * np.log(u)) / k, axis=1)
        shape, size = loo.pareto_fit(x)
        assert shape == pytest.approx(k, abs=0.05) and size == pytest.approx(scale, rel=0.05)


def test_loo_of_a_normal_mean(spark):
    """With known variance and a flat prior the density of an observation without itself is normal."""
    r = np.random.default_rng(5)
    y, draws = r.standard_normal(60), 4000
    mean = y.mean() + r.standard_normal(draws) / math.sqrt(60)
    ll = -0.5 * math.log(2 * math.pi) - (y[:, None] - mean) ** 2 / 2
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(ll)], "id long, ll array<double>")
    got = {p.id: p for p in loo.pointwise(df, "id", "ll").collect()}
    others = (y.sum() - y) / 59
    want = -0.5 * np.log(2 * math.pi * (1 + 1 / 59)) - (y - others) ** 2 / 2 / (1 + 1 / 59)
    assert [got[i].elpd for i in range(60)] == pytest.approx(want, abs=0.02) and max(p.k for p in got.values()) < 0.5
    total = loo.summary(loo.pointwise(df, "id", "ll")).first()
    assert total.elpd_loo == pytest.approx(want.sum(), abs=0.1) and total.bad == 0 and total.se == pytest.approx(want.std(ddof=1) * math.sqrt(60), rel=0.02)
    one = loo.pointwise(df, "id", "ll")
    same = loo.compared(one, one, "id").first()
    assert (same.elpd_diff, same.dse, same.n) == (0, 0, 60)


def test_loo_rows_equal_a_row_at_a_time():
    r = np.random.default_rng(6)
    ll = r.standard_normal((20, 400)) * r.uniform(0.1, 4, (20, 1))
    ll[3], ll[4, :10] = -1.0, -1e4  # equal weights; a tail that outweighs all
    whole, k = loo.psis(ll)
    for i in range(20):
        one, kk = loo.psis(ll[i : i + 1])
        assert one[0] == pytest.approx(whole[i]) and (kk[0] == k[i] or kk[0] == pytest.approx(k[i]))
    assert whole[3] == pytest.approx(-1.0) and np.isinf(k[3]) and k[0] < k[4]
    few, k = loo.psis(ll[:2, :9])
    assert np.isinf(k).all() and np.isfinite(few).all()
