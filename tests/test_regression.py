"""Poisson fits and their leave-one-out forms against full refits."""

import numpy as np
import pytest

from touchline.operators import regression as R


def newton(x, y, weight):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        m = np.exp(x @ b)
        b = b + np.linalg.solve((x * m[:, None]).T @ x + np.diag(weight), x.T @ (y - m) - weight * b)
    return b


def data(groups, per, seed, hot=0):
    r = np.random.default_rng(seed)
    n = groups * per + hot
    g = np.concatenate([np.repeat(np.arange(groups), per), np.zeros(hot, int)])
    x = np.column_stack([np.ones(n), r.standard_normal(n), r.integers(0, 2, n), r.standard_normal(n)])
    y = r.poisson(np.exp(x @ [-1.2, 0.4, 0.3, -0.2] + 0.3 * r.standard_normal(groups)[g]))
    return g, x, y


def frame(spark, g, x, y):
    return spark.createDataFrame([(int(a), int(c), [float(v) for v in b]) for a, b, c in zip(g, x, y, strict=True)], "group long, y int, x array<double>")


PRIOR = R.Prior.of(1.0, 0.5, 0.5, None)


def test_fit_equals_newton(spark):
    g, x, y = data(5, 80, 1)
    assert R.poisson(frame(spark, g, x, y), 4, PRIOR) == pytest.approx(newton(x, y, np.array(PRIOR.precision)), abs=1e-9)


@pytest.mark.parametrize(("groups", "per", "hot", "large", "within"), [(50, 40, 0, 1 / 200, 1e-8), (50, 40, 1000, 1 / 40, 5e-8), (400, 10, 0, 1 / 200, 1e-8)])
def test_leaving_a_group_out_equals_a_full_refit(spark, groups, per, hot, large, within):
    g, x, y = data(groups, per, 2, hot)
    _, fits = R.without_each(frame(spark, g, x, y), 4, PRIOR, large)
    got = {r["group"]: r for r in fits.collect()}
    assert len(got) == groups
    for k in range(min(groups, 50)):
        keep = g != k
        assert got[k]["beta"] == pytest.approx(newton(x[keep], y[keep], np.array(PRIOR.precision)), abs=within)
        assert got[k]["y"] == pytest.approx(y[~keep].mean()) and got[k]["x"] == pytest.approx(x[~keep].mean(axis=0))


def test_above_replacement_equals_its_definition(spark):
    g, x, y = data(120, 12, 3, 500)
    y[g == 7], y[g == 9], x[g == 9] = 0, 0, x[g == 7]  # a tie
    got = {r["group"]: r for r in R.above_replacement(frame(spark, g, x, y), 4, PRIOR, bucket=8).collect()}
    for k in range(120):
        b = newton(x[g != k], y[g != k], np.array(PRIOR.precision))
        d = np.array([(y[g == j] - x[g == j] @ b).mean() for j in range(120)])
        assert got[k]["delta"] == pytest.approx(d[k], abs=1e-7)
        assert got[k]["par"] == pytest.approx((np.round(np.delete(d, k) - d[k], 9) <= 0).mean(), abs=1e-12)


def test_one_group_and_none(spark):
    one = R.above_replacement(frame(spark, [3, 3], np.ones((2, 1)), [1, 2]), 1, R.Prior.of(1.0)).collect()
    assert [(r["group"], r["par"]) for r in one] == [(3, None)] and one[0]["beta"] == pytest.approx([0.0], abs=1e-9)
    assert R.above_replacement(spark.createDataFrame([], "group long, y int, x array<double>"), 2, R.Prior.of(1.0, 1.0)).collect() == []
