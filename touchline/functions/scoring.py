"""Proper scoring rules and probability-vector functions on array columns; y is the position of the class that came."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; named inside a lambda, an expression is evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hit(p: Column, y: Column) -> Column:
    """Probability of the class that came."""
    return F.element_at(p, y + 1)


def log_floored(x: Column, floor: float = 1e-12) -> Column:
    return F.ln(F.greatest(x, F.lit(floor)))


def log_score(p: Column, y: Column, floor: float = 1e-12) -> Column:
    return log_floored(hit(p, y), floor)


def log_score_shifted(p: Column, y: Column, shift: float = 1e-10) -> Column:
    """The older form: a constant is added instead of a floor."""
    return F.ln(hit(p, y) + shift)


def ranked_probability(p: Column, y: Column, normalised: bool = True) -> Column:
    """Sum of squared differences of the cumulative distributions, over K - 1 if normalised."""
    gaps = F.transform(
        F.sequence(F.lit(1), F.size(p) - 1),
        lambda k: F.pow(total(F.slice(p, 1, k)) - F.when(y < k, 1.0).otherwise(0.0), 2),
    )
    return total(gaps) / (F.size(p) - 1) if normalised else total(gaps)


def brier(p: Column, y: Column) -> Column:
    return total(F.transform(p, lambda x: x * x)) - 2 * hit(p, y) + 1


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def predicted(p: Column) -> Column:
    """First class of the largest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected(p: Column) -> Column:
    """Mean of the class numbers, as goals from category probabilities."""
    return total(F.transform(p, lambda x, i: x * i))


def tempered(p: Column, t: float | Column) -> Column:
    """p^(1/T), renormalised."""
    q = F.transform(p, lambda x: F.pow(x, F.lit(1.0) / t))
    return let(q, lambda q: let(total(q), lambda s: F.transform(q, lambda x: x / s)))


def pit(p: Column, y: Column, u: Column) -> Column:
    """Randomised probability integral transform: F(y - 1) + u * p(y)."""
    return F.when(y > 0, total(F.slice(p, 1, F.greatest(y, F.lit(1))))).otherwise(0.0) + u * hit(p, y)


def uniform(row: Column, draw: Column | int = 0) -> Column:
    """A reproducible stand-in for a uniform number, equal in every engine; analyses take rand(seed)."""
    return ((row * 7919 + draw * 104729) % 100003 + 0.5) / 100003


def poisson(rate: Column, top: int) -> Column:
    """Probabilities of 0..top events (top at most 20)."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.exp(k * F.ln(rate) - rate) / F.factorial(k))


def negative_binomial(mean: Column, size: float, top: int) -> Column:
    """Probabilities of 0..top events by recurrence over k: p(0) = (size / (size + mean))^size."""
    q = mean / (mean + size)
    first = F.array(F.pow(1 - q, F.lit(size)))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(top)), first,
        lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * q * (k - 1 + size) / k)),
    )


def win_draw_loss(home: Column, away: Column) -> Column:
    """[away, draw, home] from two count distributions by running sums: no joint grid is built."""
    draw = total(F.zip_with(home, away, lambda a, b: a * b))
    win = total(F.transform(home, lambda x, i: x * F.when(i > 0, total(F.slice(away, 1, F.greatest(i, F.lit(1))))).otherwise(0.0)))
    return F.array(total(home) * total(away) - win - draw, draw, win)


def dixon_coles(lh: Column, la: Column, rho: Column | float, h: Column, a: Column) -> Column:
    """Correction of the four low scores, kept positive."""
    tau = (
        F.when((h == 0) & (a == 0), 1 - lh * la * rho).when((h == 0) & (a == 1), 1 + lh * rho)
        .when((h == 1) & (a == 0), 1 + la * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(1.0)
    )
    return F.greatest(tau, F.lit(1e-12))


def ordered_logit(eta: Column, cuts: Column) -> Column:
    """Class probabilities from a linear predictor and ascending cut points."""
    upto = F.concat(F.array(F.lit(0.0)), F.transform(cuts, lambda c: 1 / (1 + F.exp(eta - c))), F.array(F.lit(1.0)))
    return F.transform(F.sequence(F.lit(1), F.size(upto) - 1), lambda i: F.element_at(upto, i + 1) - F.element_at(upto, i))


def quantile(ordered: Column, q: float) -> Column:
    """Quantile of an ascending array, linear between neighbours."""
    at = (F.size(ordered) - 1) * q
    low = F.floor(at).cast("int")
    left, right = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(ordered)))
    return left + (right - left) * (at - low)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def normal(row: Column, draw: Column | int, k: int = 0) -> Column:
    """A reproducible stand-in for a standard normal number (Box and Muller on two stand-ins for uniform ones)."""
    u, v = uniform(row * 7 + 2 * k, draw), uniform(row * 7 + 2 * k + 1, draw)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.lit(3.141592653589793) * v)


def interval_inside(x: Column, draws: Column, mass: float) -> Column:
    """Whether x lies in the narrowest interval that holds a share `mass` of the sorted draws (first such interval)."""
    s = F.array_sort(draws)
    w = F.floor(F.size(s) * mass).cast("int")
    widths = F.transform(F.sequence(F.lit(1), F.size(s) - w), lambda i: F.struct((F.element_at(s, i + w) - F.element_at(s, i)).alias("w"), i.alias("i")))
    best = F.array_min(widths)["i"]
    return (x >= F.element_at(s, best)) & (x <= F.element_at(s, best + w))
