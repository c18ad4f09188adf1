"""Treatment effects: differences in means by stratum, propensity, balance, regression adjustment, and adjustment sets of a graph."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import erf, lgamma, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import relational as R


def effects_by(rows: DataFrame, *strata: str) -> DataFrame:
    """Difference in mean outcome between treated and untreated by stratum; null where a cell is empty."""
    on, off = (F.avg(F.when(F.col("treated") == t, F.col("outcome"))) for t in (1, 0))
    return rows.groupBy(*strata).agg(
        F.count("*").alias("n"), F.avg("treated").alias("rate"), on.alias("treated_mean"), off.alias("control_mean"), (on - off).alias("effect")
    )


def assignment_rates(rows: DataFrame, stratum: str, unit: str) -> DataFrame:
    """Share of units (such as matches) with any treatment by stratum: a unit counts once in a stratum, however many rows it has there."""
    once = rows.groupBy(stratum, unit).agg(F.max((F.col("treated") > 0).cast("int")).alias("any"))
    return once.groupBy(stratum).agg(F.count("*").alias("units"), F.avg("any").alias("rate"))


def naive_and_adjusted(rows: DataFrame, stratum: str) -> DataFrame:
    """The plain difference and the unweighted mean of the strata's differences, empty cells skipped."""
    return effects_by(rows).select(F.col("effect").alias("naive")).crossJoin(effects_by(rows, stratum).agg(F.avg("effect").alias("adjusted")))


def quartiles(rows: DataFrame, value: str) -> DataFrame:
    """Label rows 1..4 by exact quartiles: up to q1, up to q2, up to q3, above."""
    q = R.quantiles(rows, value, [0.25, 0.5, 0.75])
    x = F.col(value)
    label = F.when(x <= F.col("q0"), 1).when(x <= F.col("q1"), 2).when(x <= F.col("q2"), 3).otherwise(4)
    return rows.crossJoin(F.broadcast(q)).withColumn("quartile", label).drop("q0", "q1", "q2")


def overlap(rows: DataFrame, score: str) -> DataFrame:
    """Range of the score on either side, and whether the ranges overlap."""
    a = rows.agg(*[f(F.when(F.col("treated") == t, F.col(score))).alias(f"{n}_{t}") for t in (0, 1) for n, f in (("low", F.min), ("high", F.max))])
    return a.withColumn("overlap", (F.col("low_0") <= F.col("high_1")) & (F.col("low_1") <= F.col("high_0")))


def propensity(rows: DataFrame, covariates: list[str], c: float = 1.0) -> DataFrame:
    """Probability of treatment by a logistic model with an L2 penalty of 1/C on standardised covariates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = rows.count()
    x = VectorAssembler(inputCols=covariates, outputCol="_raw").transform(rows)
    x = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(x).transform(x)
    model = LogisticRegression(featuresCol="_x", labelCol="treated", regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False).fit(x)
    return model.transform(x).withColumn("propensity", vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def balance(rows: DataFrame, covariate: str, score: str) -> DataFrame:
    """Standardised difference of a covariate (over the treated deviation) before and after matching each treated to one control."""
    t, c = rows.where("treated = 1"), rows.where("treated = 0")
    pairs = R.nearest(t.select("id", F.col(score).alias("s")), c.select("id", F.col(score).alias("s")), "s")
    x = rows.select(F.col("id").alias("k"), F.col(covariate).cast("double").alias("x"))
    matched = pairs.join(x, pairs.control == x.k).agg(F.avg("x").alias("matched"))
    sides = rows.agg(
        F.avg(F.when(F.col("treated") == 1, F.col(covariate))).alias("t"), F.stddev_samp(F.when(F.col("treated") == 1, F.col(covariate))).alias("sd"),
        F.avg(F.when(F.col("treated") == 0, F.col(covariate))).alias("c"),
    )
    return sides.crossJoin(matched).select(
        F.try_divide(F.col("t") - F.col("c"), F.col("sd")).alias("before"), F.try_divide(F.col("t") - F.col("matched"), F.col("sd")).alias("after")
    )


def regression(rows: DataFrame, outcome: str, terms: list[str]) -> DataFrame:
    """Ordinary least squares: rows term, estimate, se, t, p. The moments are two aggregates, the second around the means of the first;
    the solve is of the number of terms. Without rows all numbers are null; of collinear terms the smallest solution is taken and
    their errors are null."""
    cols, k = [F.col(t).cast("double") for t in terms], len(terms)
    y = F.col(outcome).cast("double")
    clean = rows.dropna(subset=[outcome, *terms])
    means = clean.agg(F.count("*").alias("n"), F.avg(y).alias("y"), *[F.avg(c).alias(f"x{i}") for i, c in enumerate(cols)]).first()
    names, schema = ["intercept", *terms], "term string, estimate double, se double, t double, p double"
    n = means["n"]
    if not n:
        return rows.sparkSession.createDataFrame([(t, None, None, None, None) for t in names], schema)
    centre = np.array([means[f"x{i}"] for i in range(k)], float)
    d, e = [c - float(m) for c, m in zip(cols, centre, strict=True)], y - float(means["y"])
    pairs = [F.sum(d[i] * d[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    m = clean.agg(*pairs, *[F.sum(c * e).alias(f"y{i}") for i, c in enumerate(d)], F.sum(e * e).alias("yy")).first()
    xtx = np.array([[m[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float).reshape(k, k)
    xty = np.array([m[f"y{i}"] for i in range(k)], float)
    inverse = np.linalg.pinv(xtx, hermitian=True) if k else xtx
    slopes = inverse @ xty
    beta = np.concatenate([[means["y"] - centre @ slopes], slopes])
    free = n - 1 - k
    variance = max(float(m["yy"] - slopes @ xty), 0.0) / free if free > 0 else np.nan
    spread = np.concatenate([[1 / n + centre @ inverse @ centre], np.diag(inverse)])
    se = np.sqrt(variance * spread) if k == 0 or np.linalg.matrix_rank(xtx, hermitian=True) == k else np.full(k + 1, np.nan)
    number = lambda x: None if np.isnan(x) else float(x)
    out = []
    for t, b, s in zip(names, beta, se, strict=True):
        z = None if np.isnan(s) or s == 0 else float(b / s)
        out.append((t, float(b), number(s), z, None if z is None else 1 - erf(abs(z) / sqrt(2))))
    return rows.sparkSession.createDataFrame(out, schema)


@dataclass(frozen=True)
class Robust:
    """A regression with Student-t errors: terms and estimates, their standard errors, the errors' scale and degrees of freedom."""

    terms: list[str]
    estimates: np.ndarray
    errors: np.ndarray
    scale: float
    freedom: float
    steps: int


def student_t(rows: DataFrame, outcome: str, terms: list[str], freedom: tuple[float, ...] = (4.0,), tolerance: float = 1e-10, most: int = 200) -> Robust | None:
    """Regression with Student-t errors by iteratively reweighted least squares; None without rows.

    Each step is one aggregate of weighted moments, whatever the number of rows: a row weighs (v + 1) / (v + r^2 / s^2) with its residual r
    under the step before; coefficients and scale follow from the moments. Of several degrees of freedom the likeliest is taken, anew in
    each step, from log-likelihoods that the same aggregate sums. Standard errors are those of the expected information.
    """
    cols, k = [F.col(t).cast("double") for t in terms], len(terms)
    y = F.col(outcome).cast("double")
    clean = rows.dropna(subset=[outcome, *terms])
    first = clean.agg(F.count("*").alias("n"), F.avg(y).alias("y"), F.var_pop(y).alias("v"), *[F.avg(c).alias(f"x{i}") for i, c in enumerate(cols)]).first()
    n = first["n"]
    if not n:
        return None
    centre, middle = np.array([first[f"x{i}"] for i in range(k)], float), float(first["y"])
    x = [F.lit(1.0), *[c - float(m) for c, m in zip(cols, centre, strict=True)]]
    e = y - middle
    beta, variance, v = np.zeros(k + 1), float(first["v"]) or 1.0, freedom[0]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for step in range(1, most + 1):
        r = e
        for b, c in zip(beta, x, strict=True):
            r = r - float(b) * c
        z = r * r / variance
        w = (v + 1) / (v + z)
        likely = [F.sum(F.log1p(z / f)).alias(f"l{i}") for i, f in enumerate(freedom)] if len(freedom) > 1 else []
        got = clean.agg(
            *[F.sum(w * x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(w * x[i] * e).alias(f"y{i}") for i in range(k + 1)], F.sum(w * e * e).alias("yy"),
            *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs], *likely,
        ).first()
        sym = lambda p: np.array([[got[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)  # noqa: E731, B023
        xtx, xty = sym("x"), np.array([got[f"y{i}"] for i in range(k + 1)], float)
        new = np.linalg.pinv(xtx, hermitian=True) @ xty
        old, beta = beta, new
        before, variance = variance, max(float(got["yy"] - 2 * new @ xty + new @ xtx @ new) / n, 1e-300)
        if likely:
            value = [lgamma((f + 1) / 2) - lgamma(f / 2) - log(f * pi) / 2 - (f + 1) / 2 * got[f"l{i}"] / n for i, f in enumerate(freedom)]
            v, kept = freedom[int(np.argmax(value))], v
        if np.abs(new - old).max() <= tolerance * (1 + np.abs(new).max()) and abs(variance - before) <= tolerance * variance and (not likely or v == kept):
            break
    information = (v + 1) / (v + 3) / variance * sym("p")
    cov = np.linalg.pinv(information, hermitian=True)
    turn = np.eye(k + 1)
    turn[0, 1:] = -centre  # the intercept of the factors as they were
    beta = turn @ beta
    beta[0] += middle
    return Robust(["intercept", *terms], beta, np.sqrt(np.diag(turn @ cov @ turn.T)), sqrt(variance), v, step)


def robust_regression(rows: DataFrame, outcome: str, terms: list[str], **settings) -> DataFrame:
    """student_t() as rows term, estimate, se, scale, freedom."""
    fit = student_t(rows, outcome, terms, **settings)
    out = [] if fit is None else [(t, float(b), float(s), fit.scale, float(fit.freedom)) for t, b, s in zip(fit.terms, fit.estimates, fit.errors, strict=True)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, se double, scale double, freedom double")


def independence(rows: DataFrame, outcome: str, tested: str, given: list[str], level: float = 1.959963984540054, robust: bool = False) -> DataFrame:
    """Whether a variable tells about the outcome beside the given ones: its coefficient, by least squares or with Student-t errors, and its
    interval."""
    fit = (robust_regression if robust else regression)(rows, outcome, [tested, *given]).where(F.col("term") == tested)
    low, high = F.col("estimate") - level * F.col("se"), F.col("estimate") + level * F.col("se")
    return fit.select(F.lit(outcome).alias("outcome"), F.col("term").alias("tested"), "estimate", low.alias("low"), high.alias("high"), ((low <= 0) & (high >= 0)).alias("independent"))


def simulate(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Matches with a confounded substitution: the worse the score, the likelier; the known effect stands beside each row."""
    r = lambda k: F.randn(seed + k)
    rows = spark.range(n).select("id", (50 + 10 * r(1)).alias("off_old"), (50 + 10 * r(2)).alias("def_old"), F.rand(seed + 3).alias("u"), F.rand(seed + 4).alias("v"))
    rows = rows.withColumn("score_diff", F.greatest(F.lit(-3), F.least(F.lit(3), F.round((F.col("off_old") - F.col("def_old")) / 10 + r(5)).cast("int"))))
    sub = F.col("u") < 1 / (1 + F.exp(0.8 * F.col("score_diff")))
    rows = rows.withColumn("sub", sub.cast("int")).withColumn("ite", 4 + 0.1 * (60 - F.col("off_old")))
    base = 30 + 0.5 * F.col("off_old") + 2 * F.col("score_diff")
    return rows.withColumns({"passes_counterfactual": base, "passes": base + F.col("sub") * F.col("ite") + 3 * r(6)}).drop("u", "v")


def true_effects(rows: DataFrame, *strata: str) -> DataFrame:
    """Mean known effect over the treated, by stratum."""
    return rows.where("sub = 1").groupBy(*strata).agg(F.avg("ite").alias("att"), F.count("*").alias("n"))


Edges = list[tuple[str, str]]


def vertices(graph: str) -> list[str]:
    """Names in a digraph text such as 'digraph { a -> b; b -> c }', in order of appearance."""
    body = graph[graph.find("{") + 1 : graph.rfind("}")] if "{" in graph else graph
    names = [v.strip().strip('"') for part in body.replace("\n", ";").split(";") for v in part.split("->")]
    return list(dict.fromkeys(n for n in names if n))


def edges_of(graph: str) -> Edges:
    """The arrows of a digraph text, chains such as a -> b -> c taken apart."""
    body = graph[graph.find("{") + 1 : graph.rfind("}")] if "{" in graph else graph
    chains = [[v.strip().strip('"') for v in part.split("->")] for part in body.replace("\n", ";").split(";") if "->" in part]
    return [(u, v) for c in chains for u, v in itertools.pairwise(c)]


def _moral_connected(edges: Edges, a: str, b: str, given: set[str]) -> bool:
    keep, grow = {a, b} | given, True
    while grow:
        more = {u for u, v in edges if v in keep} - keep
        keep |= more
        grow = bool(more)
    near: dict[str, set[str]] = {v: set() for v in keep}
    parents: dict[str, set[str]] = {v: {u for u, w in edges if w == v and u in keep} for v in keep}
    for v, ps in parents.items():
        for u in ps:
            near[u].add(v), near[v].add(u)
        for u, w in itertools.combinations(ps, 2):
            near[u].add(w), near[w].add(u)
    seen, work = {a}, [a]
    while work:
        for v in near[work.pop()] - seen - given:
            seen.add(v), work.append(v)
    return b in seen


def separated(edges: Edges, a: str, b: str, given: set[str] = frozenset()) -> bool:
    """Whether `given` d-separates a from b, by the moral graph of their ancestors."""
    return not _moral_connected(edges, a, b, set(given))


def _below(edges: Edges, top: str) -> set[str]:
    """A vertex and all that descend from it."""
    out, grow = {top}, True
    while grow:
        more = {v for u, v in edges if u in out} - out
        out |= more
        grow = bool(more)
    return out


def _subsets(names: list[str]):
    return (set(s) for n in range(len(names) + 1) for s in itertools.combinations(names, n))


def all_backdoor_sets(edges: Edges, treatment: str, outcome: str) -> list[set[str]]:
    """Sets without descendants of the treatment that block every path into it, small ones first."""
    cut = [(u, v) for u, v in edges if u != treatment]
    free = sorted({v for e in edges for v in e} - _below(edges, treatment) - {outcome})
    return [s for s in _subsets(free) if separated(cut, treatment, outcome, s)]


def backdoor_sets(edges: Edges, treatment: str, outcome: str) -> list[set[str]]:
    """The back-door sets of which no part is one."""
    out: list[set[str]] = []
    for s in all_backdoor_sets(edges, treatment, outcome):
        if not any(o <= s for o in out):
            out.append(s)
    return out


def _directed(edges: Edges, a: str, b: str, without: set[str]) -> bool:
    """Whether a directed path leads from a to b past the given vertices."""
    return b in _below([(u, v) for u, v in edges if v not in without and (u == a or u not in without)], a)


def frontdoor_sets(edges: Edges, treatment: str, outcome: str) -> list[set[str]]:
    """Sets that all directed paths to the outcome go through, that no back-door path from the treatment reaches, and whose own
    back-door paths to the outcome the treatment blocks."""
    free = sorted({v for e in edges for v in e} - {treatment, outcome})
    from_treatment = [(u, v) for u, v in edges if u != treatment]
    out = []
    for s in _subsets(free):
        if not s or _directed(edges, treatment, outcome, s):
            continue
        clear = all(separated(from_treatment, treatment, m) for m in s)
        blocked = all(separated([(u, v) for u, v in edges if u != m], m, outcome, {treatment} | (s - {m})) for m in s)
        if clear and blocked:
            out.append(s)
    return out
