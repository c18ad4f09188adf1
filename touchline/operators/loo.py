"""Leave-one-out predictive densities by Pareto-smoothed importance sampling, inside each observation's row.

A row holds the observation's log-likelihood under each posterior draw. The weight of a draw without the observation is one over its
likelihood; the largest weights are replaced by quantiles of a generalised Pareto distribution fitted to them (Vehtari, Simpson,
Gelman, Yao and Gabry), whose shape k tells whether the estimate can be trusted. The fit is the one of Zhang and Stephens: a mean of
candidate parameters, weighted by their profile likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.draws import CELLS, matrix


def pareto_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of a generalised Pareto distribution for each row of ascending positive numbers."""
    rows, n = x.shape
    m = 30 + int(math.sqrt(n))
    quarter = x[:, int(n / 4 + 0.5) - 1]
    grid = 1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    b = 1 / x[:, -1:] + grid / (3 * quarter[:, None])  # candidates
    k = np.log1p(-b[..., None] * x[:, None, :]).mean(axis=2)
    profile = n * (np.log(-b / k) - k - 1)
    weight = 1 / np.exp(np.minimum(profile[:, None, :] - profile[:, :, None], 700.0)).sum(axis=2)
    weight = np.where(weight < 10 * np.finfo(float).eps, 0.0, weight)
    theta = (b * weight).sum(axis=1) / weight.sum(axis=1)
    shape = np.log1p(-theta[:, None] * x).mean(axis=1)
    scale = -shape / theta
    return (n * shape + 5) / (n + 10), scale  # a weak prior draws the shape to a half


def psis(log_likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """elpd_loo and k of each row of log-likelihoods by draw. With too few draws for a fit, or a tail of equal weights, k is infinite and
    the weights stay as they are."""
    ratio = -log_likelihood
    ratio = ratio - ratio.max(axis=1, keepdims=True)
    rows, draws = ratio.shape
    tail = math.ceil(min(draws / 5, 3 * math.sqrt(draws)))
    k = np.full(rows, np.inf)
    if tail >= 5 and draws > tail:
        order = np.argsort(ratio, axis=1, kind="stable")
        top = order[:, -tail:]
        cut = np.maximum(np.take_along_axis(ratio, order[:, -tail - 1 : draws - tail], 1), math.log(np.finfo(float).tiny))
        large = np.take_along_axis(ratio, top, 1)
        fit = large[:, -1] - large[:, 0] > 1e-12
        fit &= large[:, 0] > cut[:, 0]
        if fit.any():
            x = np.exp(large[fit]) - np.exp(cut[fit])
            k[fit], scale = pareto_fit(x)
            p = (np.arange(tail) + 0.5) / tail
            shape = k[fit][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                quantile = np.where(np.abs(shape) < 1e-12, -np.log1p(-p), np.expm1(-shape * np.log1p(-p)) / shape) * scale[:, None]
            smooth = np.log(quantile + np.exp(cut[fit]))
            new = ratio[fit]
            np.put_along_axis(new, top[fit], np.minimum(smooth, 0.0), 1)
            ratio[fit] = new
    most = ratio.max(axis=1, keepdims=True)
    weight = ratio - most - np.log(np.exp(ratio - most).sum(axis=1, keepdims=True))
    value = weight + log_likelihood
    most = value.max(axis=1, keepdims=True)
    return (most + np.log(np.exp(value - most).sum(axis=1, keepdims=True)))[:, 0], k


def pointwise(rows: DataFrame, id: str, log_likelihood: str, cells: int = CELLS) -> DataFrame:
    """(id, elpd, k) for each observation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, cells // max(1, len(b.column("ll")[0]) if b.num_rows else 1) // 8)
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                elpd, k = psis(matrix(part, "ll"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(elpd), pa.array(k)], names=["id", "elpd", "k"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("id"), F.col(log_likelihood).alias("ll")).mapInArrow(run, f"id {kind}, elpd double, k double").withColumnRenamed("id", id)


def summary(points: DataFrame) -> DataFrame:
    """elpd_loo, its standard error, and how many observations have a shape above 0.7."""
    n = F.count("*")
    return points.agg(F.sum("elpd").alias("elpd_loo"), F.sqrt(n * F.var_samp("elpd")).alias("se"), F.count_if(F.col("k") > 0.7).alias("bad"), n.alias("n"))


def compared(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """Difference a - b of two models' elpd_loo over the same observations, and its standard error."""
    both = a.select(id, F.col("elpd").alias("_a")).join(b.select(id, F.col("elpd").alias("_b")), id).select((F.col("_a") - F.col("_b")).alias("d"))
    n = F.count("*")
    return both.agg(F.sum("d").alias("elpd_diff"), F.sqrt(n * F.var_samp("d")).alias("dse"), n.alias("n"))
