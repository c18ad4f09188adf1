"""Arrays of draws: sums, scores and boards against numpy, without rows x draws in any plan."""

import math

import numpy as np
import pytest

from touchline.operators import draws as D
from touchline.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_scores_by_draw(spark):
    p = np.array([[[0.7, 0.3], [0.4, 0.6]], [[0.6, 0.4], [0.5, 0.5]], [[0.8, 0.2], [0.3, 0.7]]])  # draws, matches, classes
    y = [0, 1]
    rows = spark.createDataFrame([("a", k, [float(v) for v in p[:, i].ravel()]) for i, k in enumerate(y)], "g string, y int, p array<double>")
    got = D.posterior_scores(rows, ["g"], 2, 3).first()
    assert got["n"] == 2 and len(got["log_loss"]) == 3
    for s in range(3):
        assert got["log_loss"][s] == pytest.approx(-np.mean([math.log(p[s, i, k]) for i, k in enumerate(y)]))
        assert got["brier"][s] == pytest.approx(np.mean([((p[s, i] - np.eye(2)[k]) ** 2).sum() for i, k in enumerate(y)]))
        assert got["rps"][s] == pytest.approx(np.mean([(p[s, i, 0] - (k == 0)) ** 2 for i, k in enumerate(y)]))


@pytest.mark.parametrize(("room", "cells"), [(1 << 26, 1 << 20), (2000, 8)])
def test_sums_with_little_room(spark, room, cells):
    r = np.random.default_rng(1)
    n = 3000
    g = np.where(r.random(n) < 0.4, 0, r.integers(0, 200, n))  # a hot key
    a, b = r.standard_normal((n, 6)), r.standard_normal((n, 2))
    rows = [(None if g[i] == 5 else int(g[i]), str(g[i] % 3), [float(v) for v in a[i]], [float(v) for v in b[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, h string, a array<double>, b array<double>").repartition(6)
    made = D.summed(df, ["g", "h"], ["a", "b"], ["a", "b"], lambda x: [D.matrix(x, "a"), D.matrix(x, "b")], 6, room, cells)
    got = {(x["g"], x["h"]): x for x in made.collect()}
    assert len(got) == len({(x[0], x[1]) for x in rows})
    for k in np.unique(g):
        x = got[None if k == 5 else int(k), str(k % 3)]
        assert x["n"] == (g == k).sum() and x["a"] == pytest.approx(a[g == k].sum(axis=0)) and x["b"] == pytest.approx(b[g == k].sum(axis=0))
    one = D.sums_of(df, [], ["a"], 6).collect()
    assert len(one) == 1 and one[0]["n"] == n and one[0]["a"] == pytest.approx(a.sum(axis=0))
    assert D.sums_of(df.limit(0), ["g"], ["a"], 6).collect() == []


def test_boards_equal_loops(spark):
    r = np.random.default_rng(2)
    n, draws = 400, 5
    player, x, effect, beta = r.integers(0, 9, n), r.standard_normal((n, 3)), r.standard_normal((9, draws)), r.standard_normal((draws, 3))
    df = spark.createDataFrame([(int(k), [float(v) for v in effect[k]], [float(v) for v in f]) for k, f in zip(player, x, strict=True)], "player long, effect array<double>, x array<double>")
    got = {b["player"]: b for b in D.boards(df, "player", beta, [0.5, 2.0], [1], 2).collect()}
    alike = x.copy()
    alike[:, 1], alike[:, 2] = 0, x[:, 2].mean()
    for name, f in (("par", x), ("sar", alike)):
        eta = effect[player] + f @ beta.T
        goals = 1 / (1 + np.exp(0.5 - eta)) + 1 / (1 + np.exp(2.0 - eta))
        for k in range(9):
            assert got[k][name] == pytest.approx(goals[player == k].mean(axis=0) - goals.mean(axis=0))


@pytest.mark.parametrize("name", ["posterior_scores", "context_boards", "skill_board", "information_criterion"])
def test_no_plan_spells_out_draws(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


def test_season_odds_with_a_seed(spark):
    from touchline.operators import counts
    from touchline.sources import tables

    games = tables.games(spark, SF).where("season = 2001")
    fixtures = counts.rates(games.where("hg is null"))
    odds = lambda g, f, seed: {(r.league, r.season, r.team): r for r in counts.season_odds(g, f, 200, seed=seed).collect()}
    one, two = odds(games, fixtures, 7), odds(games.repartition(7), fixtures.repartition(5), 7)
    assert one == two and one != odds(games, fixtures, 8)  # a draw belongs to its match, not to the task
    for league in {k[0] for k in one}:
        rows = [r for k, r in one.items() if k[0] == league]
        assert sum(r.title for r in rows) == pytest.approx(1, abs=1e-4) and sum(r.top4 for r in rows) == pytest.approx(min(4, len(rows)), abs=1e-4)
        assert all(r.low <= r.points <= r.high for r in rows)
    over = odds(games.where("hg is not null"), fixtures.limit(0), 7)
    assert all(r.low == r.high for r in over.values())
