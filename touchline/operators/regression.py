"""Poisson regression from aggregates, and what it gives without each group of rows.

Rows are (group, y, x): a count and an array of factors, of which one may be a constant. Only sums of a fixed width reach the driver. The
link is the logarithm, whose derivatives are all the rate; estimates are modes of the posterior density.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.relational import running
from touchline.sources.scratch import kept


@dataclass(frozen=True)
class Prior:
    """Normal priors around 0 by factor, as precisions; 0 is none."""

    precision: tuple[float, ...]

    @classmethod
    def of(cls, *deviations: float | None) -> Prior:
        return cls(tuple(0.0 if d is None else 1 / d**2 for d in deviations))


#: Orders of the derivatives that a leave-one-out solve takes.
ORDERS = 4


def derivatives(eta: Column, y: Column) -> list[Column]:
    """First to fourth derivative of the Poisson log-likelihood by its linear predictor, under the log link."""
    rate = F.exp(eta)
    return [y - rate, -rate, -rate, -rate]


def combinations(k: int, order: int) -> list[tuple[int, ...]]:
    """Index tuples of the distinct elements of a symmetric tensor."""
    return list(itertools.combinations_with_replacement(range(k), order))


def _sums(k: int, d: list[Column]) -> list[Column]:
    """Sums of derivative x x[i] x[j] ... by order, as columns d<order>_<number>."""
    out = []
    for order, column in enumerate(d, 1):
        for n, at in enumerate(combinations(k, order)):
            term = column
            for i in at:
                term = term * F.col("x")[i]
            out.append(F.sum(term).alias(f"d{order}_{n}"))
    return out


def _tensor(values: np.ndarray, k: int, order: int) -> np.ndarray:
    """Symmetric tensors from their distinct elements: (groups, elements) -> (groups, k, ..., k)."""
    out = np.zeros((len(values), *[k] * order))
    for n, at in enumerate(combinations(k, order)):
        for p in set(itertools.permutations(at)):
            out[(slice(None), *p)] = values[:, n]
    return out


def _predictor(beta: np.ndarray) -> Column:
    eta = F.lit(0.0)
    for i, b in enumerate(beta):
        eta = eta + F.col("x")[i] * float(b)
    return eta


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """h^-1 g for each of many small systems; of singular ones the smallest solution."""
    return np.einsum("nij,nj->ni", np.linalg.pinv(h, hermitian=True), g)


def poisson(rows: DataFrame, k: int, prior: Prior, tolerance: float = 1e-11, most: int = 50) -> np.ndarray:
    """Coefficients of largest posterior density: Newton steps, each one aggregate over the rows; a step is halved while the density falls."""
    weight = np.array(prior.precision)
    y, beta = F.col("y").cast("double"), np.zeros(k)

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = _predictor(b)
        got = rows.agg(F.sum(y * eta - F.exp(eta)).alias("l"), *_sums(k, derivatives(eta, y)[:2])).first()
        part = lambda order: np.array([[got[f"d{order}_{n}"] or 0.0 for n in range(len(combinations(k, order)))]])
        value = (got["l"] or 0.0) - float(weight @ b**2) / 2
        return value, _tensor(part(1), k, 1)[0] - weight * b, np.diag(weight) - _tensor(part(2), k, 2)[0]

    value, g, h = at(beta)
    for _ in range(most):
        step = _solve(h[None], g[None])[0]
        if np.abs(step).max(initial=0) < tolerance:
            break
        for _ in range(30):
            new = at(beta + step)
            if new[0] >= value - 1e-9 * abs(value):
                break
            step = step / 2
        beta, (value, g, h) = beta + step, new
    return beta


#: Rows of a group's fit, and the columns that it needs.
LEFT_OUT = "group long, n long, y double, x array<double>, beta array<double>, share double"


def _left_out(beta: np.ndarray, prior: Prior, total: dict[str, float]):
    """Groups' sums -> the coefficients without the group, by the Taylor series of the other rows' gradient around all rows' coefficients."""
    k, weight = len(beta), np.array(prior.precision)
    names = {o: [f"d{o}_{n}" for n in range(len(combinations(k, o)))] for o in range(1, ORDERS + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            own = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            t = [_tensor(np.column_stack([total[c] - own(c) for c in names[o]]), k, o) for o in names]
            d = np.zeros((n, k))
            for _ in range(30):
                second = np.einsum("nijk,nk->nij", t[2], d)
                third = np.einsum("nijkl,nk,nl->nij", t[3], d, d)
                first = np.einsum("nij,nj->ni", t[1] + second / 2 + third / 6, d)
                g = t[0] + first - weight * (beta + d)
                step = _solve(np.diag(weight) - (t[1] + second + third / 2), g)
                d += step
                if np.abs(step).max(initial=0) < 1e-13:
                    break
            x = np.column_stack([own(f"x{i}") for i in range(k)]) / own("n")[:, None]
            columns = [b.column("group"), b.column("n"), pa.array(own("y") / own("n")), pa.array(list(x)), pa.array(list(beta + d)), pa.array(own("n") / total["n"])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LEFT_OUT.split(", ")])

    return run


def _others(groups: np.ndarray, betas: np.ndarray):
    """Rows -> for each of a few groups the gradient and Hessian of all rows but its own, at its own coefficients; a row a task and group."""
    k = betas.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((len(groups), k)), np.zeros((len(groups), k, k))
        for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
            y, own = b.column("y").to_numpy(zero_copy_only=False).astype(float), b.column("group").to_numpy(zero_copy_only=False)
            other = own[:, None] != groups
            rate = np.where(other, np.exp(x @ betas.T), 0.0)
            g += (other * y[:, None] - rate).T @ x
            h += np.einsum("ng,ni,nj->gij", rate, x, x, optimize=True)
        columns = [pa.array(groups), pa.array(list(np.column_stack([g, h.reshape(len(groups), -1)])))]
        yield pa.RecordBatch.from_arrays(columns, names=["group", "s"])

    return run


def _refitted(rows: DataFrame, groups: np.ndarray, betas: np.ndarray, prior: Prior, tolerance: float = 1e-12) -> np.ndarray:
    """Newton steps over all rows for a few groups at once, from coefficients that are close."""
    k, weight = betas.shape[1], np.array(prior.precision)
    n = k + k * k
    for _ in range(20):
        parts = rows.select("group", "y", "x").mapInArrow(_others(groups, betas), "group long, s array<double>")
        got = {r["group"]: r["s"] for r in parts.groupBy("group").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s")).collect()}
        s = np.array([got.get(g, [0.0] * n) for g in groups])
        step = _solve(np.diag(weight) + s[:, k:].reshape(-1, k, k), s[:, :k] - weight * betas)
        betas = betas + step
        if np.abs(step).max(initial=0) < tolerance:
            break
    return betas


def without_each(rows: DataFrame, k: int, prior: Prior, large: float = 1 / 200) -> tuple[np.ndarray, DataFrame]:
    """All rows' coefficients, and a row for each group: size, means of y and x, and the coefficients fitted to all other rows.

    One aggregate by group keeps the first four derivatives of the log-likelihood as symmetric sums. A group's own sums are taken off the
    totals and the rest is solved inside the group's row, so there is no job and no scan for a group. What the series leaves out
    falls with the fourth power of the group's share of all rows. Groups of a share of `large` or more, 1 / large at most whatever the data,
    go on with exact Newton steps over all rows, all groups in one scan a step. The rows are written once, so that a step only scans them.
    """
    rows = kept(rows.select("group", "y", "x"))
    beta = poisson(rows, k, prior)
    y = F.col("y").cast("double")
    means = [F.count("*").alias("n"), F.sum(y).alias("y"), *[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(k)]]
    sums = kept(rows.groupBy("group").agg(*means, *_sums(k, derivatives(_predictor(beta), y))))
    names = ["n", *[c for c in sums.columns if c.startswith("d")]]
    total = {c: float(v or 0) for c, v in sums.agg(*[F.sum(c).alias(c) for c in names]).first().asDict().items()}
    found = sums.mapInArrow(_left_out(beta, prior, total), LEFT_OUT)
    few = found.where(F.col("share") >= large).select("group", "beta").collect()  # 1 / large groups at most
    if few:
        groups = np.array([r["group"] for r in few], np.int64)
        exact = _refitted(rows, groups, np.array([r["beta"] for r in few]), prior)
        table = rows.sparkSession.createDataFrame([(int(g), [float(v) for v in b]) for g, b in zip(groups, exact, strict=True)], "group long, exact array<double>")
        found = found.join(F.broadcast(table), "group", "left").withColumn("beta", F.coalesce("exact", "beta")).drop("exact")
    return beta, found.drop("share")


def _dot(x: str, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.col(x), b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def above_replacement(rows: DataFrame, k: int, prior: Prior, large: float = 1 / 200, bucket: int = 64) -> DataFrame:
    """For each group the share of the other groups whose mean residual y - x . beta is at most its own, with beta fitted to all rows but
    the group's: (group, delta, par, beta).

    The fit without a group moves the others' residuals by at most the largest mean factor times the step of the coefficients. So only
    groups whose residual under all rows' fit lies inside that margin of the group's own need a look; the rest is told by running counts.
    """
    beta, fits = without_each(rows, k, prior, large)
    full = F.array(*[F.lit(float(b)) for b in beta])
    fits = fits.withColumns({"at_all": F.col("y") - _dot("x", full), "delta": F.col("y") - _dot("x", F.col("beta"))})
    fits = fits.withColumn("step", F.aggregate(F.zip_with("beta", full, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v))
    fits = kept(fits)
    most = fits.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0.0
    margin = F.col("step") * float(most) + 1e-8
    end = lambda what, v: F.struct(F.lit(what).alias("what"), v.alias("v"))
    ends = F.array(end("at", F.col("at_all")), end("low", F.col("delta") - margin), end("high", F.col("delta") + margin))
    ranked = fits.select("group", F.explode(ends).alias("e")).select("group", "e.*").withColumn("one", (F.col("what") == "at").cast("long"))
    ranked = running(ranked, "v", ["one"]).groupBy("group").pivot("what", ["at", "low", "high"]).agg(F.first("one_sum"))  # three rows a group
    place = kept(fits.join(ranked, "group"))
    other = place.select(F.col("group").alias("other"), F.col("y").alias("o_y"), F.col("x").alias("o_x"), "at", F.floor((F.col("at") - 1) / bucket).alias("bucket"))
    asked = place.select("group", "delta", "beta", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor((F.greatest("high", F.lit(1)) - 1) / bucket))).alias("bucket"))
    near = asked.join(other, "bucket").where("at > low and at <= high and group <> other")
    under = F.round(F.col("o_y") - _dot("o_x", F.col("beta")) - F.col("delta"), 9) <= 0
    near = near.where(under).groupBy("group").agg(F.count("*").alias("near"))
    n = place.agg(F.count("*").alias("groups"))
    own = ((F.col("at") <= F.col("low"))).cast("long")  # the group itself counts among those below only if it moved far up
    out = place.join(near, "group", "left").crossJoin(F.broadcast(n))
    par = F.try_divide((F.col("low") - own + F.coalesce("near", F.lit(0))).cast("double"), F.col("groups") - 1)
    return out.select("group", "delta", par.alias("par"), "beta")
