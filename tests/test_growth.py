"""Work that must not grow faster than the input: what is computed once, compiled, bounded in memory or never shuffled."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import counts as C
from touchline.operators import draws as D
from touchline.operators import evaluation as E
from touchline.operators import features, ratings
from touchline.operators import regression as P
from touchline.operators import relational as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(spark, df, key):
    """The rows, and an accumulator of how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_draws_are_compiled_and_made_once(spark):
    rated = spark.range(200).select(F.col("id").alias("match_id"), (0.1 + F.col("id") % 7 / 2.0).alias("lh"), (0.2 + F.col("id") % 5 / 3.0).alias("la"))
    drawn = C.replicates(rated, 10)
    assert "lambda" not in plan(drawn)
    for r in drawn.collect():
        for i, (rate, got) in enumerate(((r.lh, r.h), (r.la, r.a))):
            u = (((r.match_id * 2 + i) * 7919 + r.draw * 104729) % 100003 + 0.5) / 100003
            below = np.cumsum([math.exp(k * math.log(rate) - rate) / math.factorial(k) for k in range(12)])
            assert got == (below < u).sum()
    rows, seen = counted(spark, drawn.select((F.col("h") + F.col("a")).alias("n")), "n")
    got = E.plausible(rows, "n", {3: None, 9: 0.5}).first()
    values = np.array([r.h + r.a for r in drawn.collect()])
    assert seen.value == 2000
    assert got.most == values.max() and abs(got.mean - values.mean()) < 1e-12 and abs(got.above_3 - (values > 3).mean()) < 1e-12
    assert np.allclose([got.median, got.q90, got.q99, got.q999], np.quantile(values, [0.5, 0.9, 0.99, 0.999]))


def test_quantiles_of_repeated_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.5, 1), (7.0, 6)], "x double, k long")
    want = np.quantile(np.repeat([1.0, 2.5, 7.0], [3, 1, 6]), [0.1, 0.35, 0.5])
    assert np.allclose(list(R.quantiles(df, "x", [0.1, 0.35, 0.5], times="k").first()), want)


def test_regression_steps_scan_rows_that_were_written_once(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("group"), (F.col("id") % 3).alias("y"), F.array(F.lit(1.0), F.col("id") % 7 / 7.0).alias("x"))
    rows, seen = counted(spark, rows, "group")
    assert P.above_replacement(rows, 2, P.Prior.of(1.0, 1.0)).count() == 20
    assert seen.value == 400


@pytest.mark.parametrize("key", [[], ["league"]])
def test_ratings_by_slices_of_time_are_those_of_one_fold(spark, key):
    n = F.col("id")
    games = spark.range(600).select(
        n.alias("match_id"), F.concat(F.lit("L"), n % 3).alias("league"), F.floor(2000 + n / 150).cast("int").alias("season"),
        F.when(n > 5, F.date_add(F.lit("2000-01-01").cast("date"), (n * 2 + n % 3).cast("int"))).alias("kick_off"), (n * 7 % 11).alias("home"), (n * 7 % 11 + 1 + n % 4).alias("away"),
        F.when(n % 13 > 0, n % 4).alias("hg"), (n % 3).alias("ag"),
    )
    stored = ratings._standing(spark.createDataFrame([("L1", 3, 1500.0, 1999)], "league string, team long, elo double, seen int"))
    rows = ratings._rows(games).unionByName(stored)
    for rules in (ratings.Rules(), ratings.Rules(returning="ever", unplayed="frozen", resets=False)):
        whole, sliced = (sorted(ratings._stream(rows, rules, key, at_once=k).collect()) for k in (10**6, 64))
        assert len(whole) == 600 and whole == sliced


def test_scores_of_tilted_forecasts(spark):
    rng = np.random.default_rng(5)
    p, beta, y = rng.dirichlet([1, 2, 3], 40), rng.normal(size=(40, 6)), rng.integers(0, 3, 40)
    q = p[:, None] * np.exp(np.array([-1.0, 0.0, 1.0]) * beta[:, :, None])
    q /= q.sum(axis=2, keepdims=True)
    rows = [(i % 3, p[i].tolist(), int(y[i]), beta[i].tolist(), q[i].ravel().tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "g long, p array<double>, y int, beta array<double>, q array<double>")
    want = {r.g: r for r in D.posterior_scores(df.select("g", "y", F.col("q").alias("p")), ["g"], 3, 6).collect()}
    for r in D.tilted_scores(df, ["g"], [-1.0, 0.0, 1.0], 6).collect():
        assert r.n == want[r.g].n
        assert all(np.allclose(r[c], want[r.g][c], atol=1e-12) for c in ("log_loss", "rps", "brier"))


def test_scores_over_draws_reach_python_as_forecasts_and_effects(spark):
    from touchline.plans.catalogue import QUERIES

    text = plan(QUERIES["posterior_scores"](spark, "/root/testdata/sf0.001"))
    assert "flatten(" not in text and "exp(" not in text.lower()


def test_rows_of_a_key_are_gathered_but_no_frequent_key_in_one_task(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"), F.array(F.col("id") / 7.0).alias("x"))
    got = D.gathered(rows, "k", "x", 4).select("k", F.spark_partition_id().alias("t")).groupBy("k", "t").count().collect()
    assert sum(r["count"] for r in got) == 4000 and len(got) <= 50 * 4
    assert max(r["count"] for r in got if r.k == 0) < 3000


def test_both_sides_of_a_match_come_from_one_window_and_few_sorts(spark):
    from touchline.plans.catalogue import QUERIES

    sorts = {n: plan(QUERIES[n](spark, "/root/testdata/sf0.001")).count(" Sort [") for n in ("interaction_features", "momentum", "player_windows")}
    assert sorts["interaction_features"] <= 9 and sorts["momentum"] <= 9 and sorts["player_windows"] == 1


def test_momentum_of_some_half_lives_at_once(spark):
    n = F.col("id")
    df = spark.range(1500).select(n.alias("i"), (n % 2).alias("k"), F.when(n % 11 > 0, (n % 17).cast("double")).alias("x"))
    for halves in ({"a": 1.0, "b": 8.0}, {"a": 0.25, "b": 8.0}):
        got = features.ewmas(df, "x", ["k"], ["i"], halves).orderBy("k", "i").toPandas()
        for name, half in halves.items():
            want = got.groupby("k").x.transform(lambda v, h=half: v.ewm(halflife=h, adjust=True, ignore_na=False).mean())
            assert np.allclose(got[name], want, equal_nan=True, rtol=1e-12)


@pytest.mark.parametrize("kind", ["bent", "even", "few", "one"])
def test_distance_from_uniform_looks_into_few_bins(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = {"bent": rng.random(6000) ** 1.3, "even": rng.random(6000), "few": rng.integers(0, 4, 6000) / 3, "one": np.array([0.25])}[kind]
    seen = []
    whole = E.running
    monkeypatch.setattr(E, "running", lambda rows, *a, **k: seen.append(rows.count()) or whole(rows, *a, **k))
    got = E.ks_uniform(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 512).first()
    s, n = np.sort(x), len(x)
    last = np.searchsorted(s, s, "right") / n
    first = np.searchsorted(s, s, "left") / n
    assert got.n == n and abs(got.d - max((last - s).max(), (s - first).max())) < 1e-12
    assert kind != "bent" or seen[0] < n / 10


def test_ledgers_read_appearances_that_were_joined_once(spark):
    from touchline.plans.catalogue import QUERIES

    assert plan(QUERIES["player_ledger_merge"](spark, "/root/testdata/sf0.001")).count("lineitem.parquet") == 0


def test_residuals_leave_draws_out_of_the_rows(spark):
    """Medians over draws against plain loops; no row carries or sorts the draws, and odd rows count as before."""
    beta = [[0.5, 1.0], [-0.25, 2.0], [1.5, -1.0], [0.0, 0.125]]
    some = [(1, 2, [1.0, 0.5]), (1, 0, [0.0, 0.25]), (2, 1, [1.0, 0.75]), (2, None, [1.0, 0.5]), (3, 4, [0.0, None]), (4, 1, [1.0]), (4, 3, [1.0, 2.0, 3.0]), (5, 1, None), (None, 1, [0.0, 1.0]), (6, 0, [float("nan"), 0.0])]
    rows = spark.createDataFrame(some, "player long, y long, x array<double>")
    frame = lambda b: spark.createDataFrame([(b,)], "by_draw array<array<double>>")

    def expected(beta):
        by = {}
        for p, y, x in some:
            ok = y is not None and x is not None and len(x) == 2 and None not in x and not any(None in b for b in beta)
            by.setdefault(p, []).extend([float(np.median([y - (x[0] * b[0] + x[1] * b[1]) for b in beta]))] if ok else [])
        delta = {p: round(float(np.mean(v)), 9) if v else None for p, v in by.items()}
        at = lambda v: -math.inf if v is None else math.inf if math.isnan(v) else v  # noqa: E731  no residual comes first, not a number last
        return {p: (v, (sum(at(u) <= at(v) for u in delta.values()) - 1) / (len(delta) - 1)) for p, v in delta.items() if v is not None}

    for b in (beta, beta[:3]):
        out = C.above_replacement(rows, frame(b))
        assert "by_draw" not in plan(out) and "array_sort" not in plan(out)
        got, want = {r["player"]: (r["delta"], r["par"]) for r in out.collect()}, expected(b)
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], nan_ok=True) for p in got)
    assert C.above_replacement(rows, frame([[1.0, None]])).collect() == []
    assert C.above_replacement(rows, frame(beta).limit(0)).collect() == C.above_replacement(rows.limit(0), frame(beta)).collect() == []


def test_audit_of_appearances_moves_them_once(spark):
    """Appearances go to their matches before they have anything of them, then once to the windows, which share a sort."""
    from touchline.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small
    try:
        text = plan(QUERIES["player_audit"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    checks = text[text.index("Window [") :]
    assert checks.count("Exchange hashpartitioning") == 5  # to the windows; line-ups where they are grouped and to their matches; goals; matches
    windows = checks[: checks.index("Join [")]
    assert windows.count("Window [") == 3 and windows.count("Sort [") == 1


@pytest.mark.parametrize("first", [False, True])
def test_goals_join_in_either_order(spark, first):
    """Line-ups without a match go, those without goals stay; nulls meet nothing, repeated matches repeat their rows."""
    games = spark.createDataFrame([(1, "a", 10, 11), (1, "b", 10, 11), (2, None, 12, None), (None, "a", 1, 2)], "match_id long, league string, home long, away long")
    lineup = spark.createDataFrame([(1, 7, 1, 0), (1, None, 0, 1), (2, 7, None, 0), (2, 8, 0, 0), (3, 7, 1, 0), (None, 7, 1, 0)], "match_id long, player long, home_pitch int, substitute_in int")
    scorers = spark.createDataFrame([(1, 7, 44), (1, 7, 45), (1, None, 3), (2, 8, None), (None, 7, 5), (3, 9, 5)], "match_id long, player long, minute int")
    got = features.player_goals(games, lineup, scorers, **({"goals_first": True} if first else {}))
    assert got.columns == ["match_id", "player", "home_pitch", "substitute_in", "league", "home", "away", "goals", "first_half", "second_half", "minutes_left", "team"]
    rows = sorted((tuple(r[c] for c in ("match_id", "league", "player", "team", "goals", "first_half", "second_half", "minutes_left")) for r in got.collect()), key=str)
    assert rows == sorted([(1, x, 7, 10, 2, 1, 1, 45.5) for x in "ab"] + [(1, x, None, 11, 0, 0, 0, None) for x in "ab"] + [(2, None, 7, None, 0, 0, 0, None), (2, None, 8, None, 1, 0, 0, None)], key=str)
