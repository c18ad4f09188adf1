"""Evaluation of probability forecasts: metrics by group, calibration tables, bootstrap, temperature and tests."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.operators.relational import dealt, quantiles, running
from touchline.sources.scratch import kept


def metrics(rows: DataFrame, *groups: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), (-F.avg(S.log_score(p, y))).alias("log_loss"), (-F.avg(S.log_score_shifted(p, y))).alias("log_loss_shifted"),
        F.avg(S.ranked_probability(p, y)).alias("rps"), F.avg(S.ranked_probability(p, y, False)).alias("rps_raw"), F.avg(S.brier(p, y)).alias("brier"),
        F.avg(S.entropy(p)).alias("entropy"), F.avg((S.predicted(p) == y).cast("double")).alias("accuracy"),
        F.avg(F.abs(S.predicted(p) - y)).alias("ordinal_mae"), F.avg(F.abs(S.expected(p) - y)).alias("expected_mae"),
    )


def reliability(rows: DataFrame, k: int, bins: int) -> DataFrame:
    """Equal-width bins of the probability of class k: observed and predicted shares; empty bins have nulls and a count of 0."""
    x = F.element_at("p", k + 1)
    at = F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")
    got = rows.groupBy(at.alias("bin")).agg(
        F.count("*").alias("count"), F.avg((F.col("y") == k).cast("double")).alias("observed"), F.avg(x).alias("predicted")
    )
    all_bins = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(got, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def reliability_curves(rows: DataFrame, classes: int, bins: int, least: int) -> DataFrame:
    """Reliability of every class: (class, bin, count, observed, predicted) of the bins that hold at least `least` forecasts. Bins are half-open,
    so that a probability of 1 is in none. One aggregate; a row has as many entries as there are classes."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col("p")[k].alias("x"), (F.col("y") == k).cast("double").alias("hit")) for k in range(classes)]))
    rows = rows.select(each.alias("e")).select("e.*").withColumn("bin", F.floor(F.col("x") * bins).cast("int")).where(F.col("bin") < bins)
    got = rows.groupBy("class", "bin").agg(F.count("*").alias("count"), F.avg("hit").alias("observed"), F.avg("x").alias("predicted"))
    return got.where(F.col("count") >= least)


def adoption(rows: DataFrame, metrics: list[str], *groups: str, least: float = 2.5) -> DataFrame:
    """Whether a challenger is taken over: rows hold its difference to the incumbent in each metric, lower being better. It qualifies if all
    mean differences are negative and all paired t statistics are at least `least` in size."""
    out = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], *[F.try_divide(F.avg(m), F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_t") for m in metrics]
    )
    ok = F.lit(True)
    for m in metrics:
        ok = ok & F.coalesce((F.col(m) < 0) & (F.abs(f"{m}_t") >= least), F.lit(False))
    return out.withColumn("qualifies", ok)


def binary_log_loss(y: Column, p: Column, floor: float = 1e-5) -> Column:
    """Log loss of a yes-or-no forecast whose two probabilities are floored."""
    return -((1 - y) * S.log_floored(1 - p, floor) + y * S.log_floored(p, floor))


def joint_hits(rows: DataFrame, classes: int) -> DataFrame:
    """Share of all rows whose class came and was predicted, for each class, their sum, and the sum without class 0; y and y_hat."""
    share = [F.avg(((F.col("y") == k) & (F.col("y_hat") == k)).cast("double")) for k in range(classes)]
    total = sum(share[1:], F.lit(0.0))
    return rows.agg(*[s.alias(f"class_{k}") for k, s in enumerate(share)], (share[0] + total).alias("all"), total.alias("above_0"))


def plausible(rows: DataFrame, count: str, limits: dict[int, float | None]) -> DataFrame:
    """Moments, quantiles and exceedances of simulated counts, from counts by value, and whether all exceedances are below their limits
    (None: no limit): the check of a prior by what it predicts."""
    by = kept(rows.groupBy(F.col(count).cast("double").alias("v")).agg(F.count("*").alias("c")))  # the draws are made once
    n, ok = F.sum("c"), F.lit(True)
    above = {k: F.sum(F.when(F.col("v") > k, F.col("c")).otherwise(0)) / n for k in limits}
    for k, most in limits.items():
        ok = ok if most is None else ok & (above[k] < most)
    q = quantiles(by, "v", [0.5, 0.9, 0.99, 0.999], times="c").toDF("median", "q90", "q99", "q999")
    one = by.agg((F.sum(F.col("v") * F.col("c")) / n).alias("mean"), F.max("v").cast(rows.schema[count].dataType).alias("most"), *[x.alias(f"above_{k}") for k, x in above.items()], ok.alias("plausible"))
    return one.crossJoin(q)


def calibration_error(rows: DataFrame, bins: int, realised: bool) -> DataFrame:
    """Expected calibration error: bins of the realised class's probability, half-open so that 1 is lost, or of the confidence, last bin closed."""
    p, y = F.col("p"), F.col("y")
    x = S.hit(p, y) if realised else F.array_max(p)
    at = F.floor(x * bins) if realised else F.least(F.floor(x * bins), F.lit(bins - 1))
    got = rows.select(at.alias("bin"), x.alias("x"), (S.predicted(p) == y).cast("double").alias("ok")).where(F.col("bin") < bins)
    got = got.groupBy("bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("ok").alias("ok"))
    return got.agg((F.sum(F.col("n") * F.abs(F.col("x") - F.col("ok"))) / F.sum("n")).alias("ece"))


def bootstrap(rows: DataFrame, id: str, value: Column, draws: int, groups: list[str] = [], seed: int | None = None) -> DataFrame:
    """Bayesian bootstrap of the mean: Dirichlet(1) weights as normalised exponentials; one row per draw (and group).

    Rows meet their draws inside a map-side partial sum; what is shuffled is two numbers per draw, group and task.
    """
    ks = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    rows = dealt(rows.select(*groups, F.col(id).alias("_id"), value.alias("_v")), "_id").select("*", ks)
    w = -F.ln(F.rand(seed) if seed is not None else S.uniform(F.col("_id"), F.col("draw")))
    return rows.withColumn("_w", w).groupBy(*groups, "draw").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"))


def interval(draws: DataFrame, value: str, *groups: str) -> DataFrame:
    """Mean, central 95 % interval and the share of draws below 0."""
    return draws.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"),
        F.avg((F.col(value) < 0).cast("double")).alias("p_better"),
    )


def paired_t(rows: DataFrame, difference: Column, *groups: str) -> DataFrame:
    n, mean, sd = F.count(difference), F.avg(difference), F.stddev_samp(difference)
    return rows.groupBy(*groups).agg(n.alias("n"), mean.alias("mean"), F.try_divide(mean, sd / F.sqrt(n)).alias("t"))


def temperatures(rows: DataFrame, grid: list[float], *groups: str) -> DataFrame:
    """Mean log-loss of p^(1/T) for every T of a grid: one aggregate with a column for each T, no row is multiplied. How many classes
    there are is asked first, so that all of it is plain arithmetic."""
    classes = rows.agg(F.max(F.size("p"))).first()[0] or 1
    logs = [F.ln(F.get("p", F.lit(k))).alias(f"_l{k}") for k in range(classes)]
    r = dealt(rows.select(*groups, *logs, F.ln(F.get("p", F.col("y"))).alias("_hit")), "_hit")

    def loss(power: float):
        whole = sum((F.coalesce(F.exp(F.col(f"_l{k}") * power), F.lit(0.0)) for k in range(1, classes)), F.coalesce(F.exp(F.col("_l0") * power), F.lit(0.0)))
        return -F.avg(F.greatest(F.col("_hit") * power - F.ln(whole), F.lit(math.log(1e-12))))

    one = r.groupBy(*groups).agg(F.count("*").alias("n"), *[loss(1.0 / t).alias(f"t{k}") for k, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"t{k}").alias("log_loss")) for k, t in enumerate(grid)])
    return one.select(*groups, "n", F.explode(pairs).alias("x")).select(*groups, "x.t", "x.log_loss", "n")


def leave_one_out_temperature(rows: DataFrame, fold: str, low: float = 0.3, high: float = 3.0, nodes: int = 24) -> DataFrame:
    """For each fold the T between the bounds that is best on all other folds: rows (fold, t, log_loss on the others).

    A fold's loss is a smooth function of 1/T; one scan gives its values at Chebyshev nodes, a few hundred numbers, and each fold's
    minimum is found on the interpolant by golden section. A fold without others has no temperature.
    """
    a, b = 1 / high, 1 / low
    x = [(a + b) / 2 + (b - a) / 2 * math.cos(math.pi * (k + 0.5) / nodes) for k in range(nodes)]
    weight = [(-1) ** k * math.sin(math.pi * (k + 0.5) / nodes) for k in range(nodes)]
    got = temperatures(rows, [1 / v for v in x], fold).select(fold, "t", (F.col("log_loss") * F.col("n")).alias("s"), "n").collect()
    sums: dict = {}
    for name, t, s, n in got:
        sums.setdefault(name, ({}, n))[0][min(range(nodes), key=lambda k: abs(x[k] - 1 / t))] = s
    out = []
    for name in sums:
        others = [v for k, v in sums.items() if k != name]
        n = sum(c for _, c in others)
        if not n:
            continue
        y = [sum(v[k] for v, _ in others) / n for k in range(nodes)]

        def value(at: float, y: list[float] = y) -> float:
            near = [(k, at - v) for k, v in enumerate(x)]
            for k, d in near:
                if d == 0:
                    return y[k]
            return sum(weight[k] / d * y[k] for k, d in near) / sum(weight[k] / d for k, d in near)

        best = golden(value, a, b)
        out.append((name, 1 / best, value(best)))
    kind = rows.schema[fold].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"{fold} {kind}, t double, log_loss double")


def golden(f, low: float, high: float, tolerance: float = 1e-8) -> float:
    """Minimum of a unimodal function by golden section."""
    ratio = (math.sqrt(5) - 1) / 2
    c, d = high - ratio * (high - low), low + ratio * (high - low)
    fc, fd = f(c), f(d)
    while high - low > tolerance:
        if fc <= fd:
            high, d, fd = d, c, fc
            c = high - ratio * (high - low)
            fc = f(c)
        else:
            low, c, fc = c, d, fd
            d = low + ratio * (high - low)
            fd = f(d)
    return (low + high) / 2


def ks_uniform(rows: DataFrame, value: str, bins: int = 1 << 14) -> DataFrame:
    """Kolmogorov-Smirnov distance from the uniform law.

    One scan counts the values by bins and keeps each bin's least and greatest, at which the distance is known. No value of a bin can
    lie further off than its count allows; only bins that could hold more than the largest known distance are looked into, by counts by
    distinct value and their running sums by value ranges. Nulls count among all rows, as the last ones.
    """
    x = F.col(value).cast("double")
    at = F.when(F.isnan(x), bins).otherwise(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (bins - 1))).cast("int")
    binned = rows.select(x.alias("x"), F.when(x.isNotNull(), at).otherwise(bins + 1).alias("bin"))
    by = kept(binned.groupBy("bin").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")))  # a row a bin
    upto = F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.sum("c").over(Window.partitionBy())
    known = by.select("bin", "low", "high", (upto - F.col("c")).alias("below"), (upto / all_).alias("f1"), ((upto - F.col("c")) / all_).alias("f0"), all_.alias("n"))
    known = kept(known)
    least = known.agg(F.max(F.greatest(F.col("f1") - F.col("high"), F.col("low") - F.col("f0"))).alias("least"), F.max("n").alias("n"))
    open_ = known.crossJoin(F.broadcast(least.select("least"))).where(F.greatest(F.col("f1") - F.col("low"), F.col("high") - F.col("f0")) > F.col("least"))
    inside = binned.join(F.broadcast(open_.select("bin", "below", "n")), "bin").groupBy("bin", "x").agg(F.count("*").alias("c"), F.first("below").alias("below"), F.first("n").alias("n"))
    inside = running(kept(inside), "x", ["c"], groups=("bin",))
    to = F.col("below") + F.col("c_sum")
    more = inside.agg(F.max(F.greatest(to / F.col("n") - F.col("x"), F.col("x") - (to - F.col("c")) / F.col("n"))).alias("more"))
    return least.crossJoin(more).select(F.greatest("least", "more").alias("d"), "n")


def ks_p_value(d: float, n: int) -> float:
    """Asymptotic p-value of a distance."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sum with average ties, from counts by distinct score."""
    by = rows.groupBy(score).agg(F.sum(label).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    by = running(by, score, ["n"]).withColumn("rank", F.col("n_sum") - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return by.agg(((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def wasserstein(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Area between two empirical distribution functions, from counts by distinct value."""
    x = a.select(F.col(value).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(value), F.lit(0), F.lit(1)))
    by = x.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # the area is the sum over gaps between neighbouring values: each value closes one gap and opens the next
    by = running(by, "x", ["a", "b"], totals=True)
    f = F.col("a_sum") / F.col("a_all") - F.col("b_sum") / F.col("b_all")
    before = (F.col("a_sum") - F.col("a")) / F.col("a_all") - (F.col("b_sum") - F.col("b")) / F.col("b_all")
    return by.agg(F.sum(F.col("x") * (F.abs(before) - F.abs(f))).alias("distance"))


def distance_ranks(a: DataFrame, b: DataFrame, values: list[str], digits: int = 3) -> DataFrame:
    """Wasserstein distance of each feature between two samples, rounded, and its rank from 0; ties keep the order of the features."""
    out = None
    for k, v in enumerate(values):
        one = wasserstein(a, b, v).select(F.lit(k).alias("_k"), F.lit(v).alias("feature"), F.round("distance", digits).alias("distance"))
        out = one if out is None else out.union(one)
    return out.withColumn("rank", (F.row_number().over(Window.orderBy("distance", "_k")) - 1).cast("int")).drop("_k")  # one row per feature


def wald(p: float, n: int, level: float = 0.95) -> tuple[float, float]:
    z = NormalDist().inv_cdf(0.5 + level / 2)
    half = z * (p * (1 - p) / n) ** 0.5
    return p - half, p + half


def two_proportions(p1: float, n1: int, p2: float, n2: int) -> tuple[float, float]:
    """z and two-sided p-value of a difference of proportions."""
    pool = (p1 * n1 + p2 * n2) / (n1 + n2)
    z = (p1 - p2) / (pool * (1 - pool) * (1 / n1 + 1 / n2)) ** 0.5
    return z, 2 * (1 - NormalDist().cdf(abs(z)))


def sample_size(p1: float, p2: float, power: float = 0.8, level: float = 0.05) -> float:
    """Observations in each group that tell two proportions apart."""
    z = NormalDist().inv_cdf(1 - level / 2) + NormalDist().inv_cdf(power)
    return z * z * (p1 * (1 - p1) + p2 * (1 - p2)) / (p1 - p2) ** 2
