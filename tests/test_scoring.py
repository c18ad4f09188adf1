"""Hand-computed values of scoring rules, counts and scalars."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.functions import scoring as P
from touchline.operators import causal, evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    ("column", "value"),
    [
        (lambda: P.log_score(vec(0.7, 0.2, 0.1), F.lit(0)), math.log(0.7)),
        (lambda: P.ranked_probability(vec(0.2, 0.5, 0.3), F.lit(1)), 0.065),
        (lambda: P.ranked_probability(vec(0, 0, 1, 0), F.lit(2)), 0.0),
        (lambda: P.ranked_probability(vec(0.2, 0.5, 0.3), F.lit(1), False), 0.13),
        (lambda: P.brier(vec(0.7, 0.2, 0.1), F.lit(0)), 0.14),
        (lambda: P.entropy(vec(0.25, 0.25, 0.25, 0.25)), math.log(4)),
        (lambda: P.pit(vec(0.5, 0.5), F.lit(1), F.lit(0.5)), 0.75),
        (lambda: P.pit(vec(0.5, 0.5), F.lit(0), F.lit(0.5)), 0.25),
        (lambda: P.expected(vec(0.5, 0.25, 0.25)), 0.75),
        (lambda: S.softplus(F.lit(0.0)), math.log(2)),
        (lambda: S.guarded_ratio(F.lit(3), F.lit(0)), 0.0),
        (lambda: S.log_guard(F.lit(-2.0)), 0.0),
    ],
)
def test_value(spark, column, value):
    assert one(spark, column()) == pytest.approx(value, abs=1e-12)


def test_log_score_floor(spark):
    x = one(spark, P.log_score(vec(1, 0), F.lit(1)))
    assert math.isfinite(x) and x < -20


def test_reliability(spark):
    rows = spark.createDataFrame([([0.9, 0.1], 0), ([0.9, 0.1], 0), ([0.1, 0.9], 1), ([0.1, 0.9], 1)], "p array<double>, y int")
    got = evaluation.reliability(rows, 1, 2).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 2] and [r["observed"] for r in got] == [0.0, 1.0]
    assert [r["predicted"] for r in got] == pytest.approx([0.1, 0.9])


def test_devig(spark):
    p = one(spark, S.implied(F.lit(1.5), F.lit(4.0), F.lit(6.0)))
    assert sum(p) == pytest.approx(1) and p[2] > p[1] > p[0]
    assert one(spark, S.overround(F.lit(1.5), F.lit(4.0), F.lit(6.0))) > 1


def test_simplex(spark):
    assert sum(one(spark, P.ordered_logit(F.lit(0.3), vec(0.5, 1.5)))) == pytest.approx(1)
    assert sum(one(spark, P.poisson(F.lit(1.3), 15))) == pytest.approx(1, abs=1e-9)
    assert sum(one(spark, P.negative_binomial(F.lit(1.3), 3.0, 60))) == pytest.approx(1, abs=1e-9)
    assert sum(one(spark, S.softmax(vec(1, 2, 3)))) == pytest.approx(1)
    assert sum(one(spark, P.tempered(vec(0.2, 0.3, 0.5), 2.0))) == pytest.approx(1)


def test_match_id_parts(spark):
    parts = S.parse_match_id(F.lit("PL-S2425_GD7-2_G3"))
    assert [one(spark, parts[k]) for k in ("league", "season", "gameday", "number")] == ["PL", "2425", 7, 3]
    assert [one(spark, parts[k]) for k in ("gameday",)] and one(spark, S.parse_match_id(F.lit("x"))["gameday"]) is None
    assert one(spark, S.season_label(F.lit(708))) == "2007/08" and one(spark, S.season_code(F.lit("2024/25"))) == "2425"


def test_bootstrap_centre(spark):
    rows = spark.range(400).select("id", (F.lit(2.0) + (F.col("id") % 7) / 10).alias("v"))
    i = evaluation.interval(evaluation.bootstrap(rows, "id", F.col("v"), 100, seed=1), "mean").first()
    assert abs(i["mean"] - 2.3) < 0.05 and i["low"] < i["mean"] < i["high"] and i["p_better"] == 0


def test_tests():
    low, high = evaluation.wald(0.5, 100)
    assert (low, high) == pytest.approx((0.402, 0.598), abs=1e-3)
    assert evaluation.two_proportions(0.6, 100, 0.5, 100)[0] == pytest.approx(1.4213, abs=1e-3)
    assert 2300 < evaluation.sample_size(0.64, 0.60) < 2500
    assert evaluation.ks_p_value(0.01, 100) > 0.99 > 0.01 > evaluation.ks_p_value(0.3, 1000)


def test_graph():
    edges = [("s", "t"), ("s", "y"), ("t", "m"), ("m", "y")]
    assert causal.vertices("digraph { s -> t; s -> y; t -> m; m -> y }") == ["s", "t", "y", "m"]
    assert causal.backdoor_sets(edges, "t", "y") == [{"s"}]
    assert not causal.separated(edges, "t", "y") and causal.separated(edges, "t", "y", {"s", "m"})
    assert causal.separated([("a", "c"), ("b", "c")], "a", "b") and not causal.separated([("a", "c"), ("b", "c")], "a", "b", {"c"})


def test_simulated_effect(spark):
    rows = causal.simulate(spark, 4000, 3).cache()
    att = causal.true_effects(rows).first()["att"]
    fit = {r.term: r.estimate for r in causal.regression(rows, "passes", ["sub", "off_old", "score_diff"]).collect()}
    assert abs(fit["sub"] - att) < 0.6
