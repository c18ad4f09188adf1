"""Count forecasts: grids, bands over draws, boards and the season simulation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from touchline.functions import scoring as S
from touchline.operators.draws import CELLS, against_all, banded, matrix, summed, sums_of
from touchline.operators.ladder import match_points
from touchline.operators.relational import dealt, quantiles, running


def linear_predictor(rows: DataFrame, x: str, beta: str, base: str) -> DataFrame:
    """eta by draw: base + x . beta, with beta an array of coefficient arrays by draw."""
    dot = lambda b: F.aggregate(F.zip_with(F.col(x), b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("eta", F.transform(beta, lambda b: F.col(base) + dot(b)))


def rates(games: DataFrame) -> DataFrame:
    """Expected goals of both sides, a function of the match's key."""
    return games.withColumns({"lh": F.lit(0.4) + (F.col("match_id") % 17) / 10.0, "la": F.lit(0.3) + (F.col("match_id") % 13) / 10.0})


def fixture_rates(games: DataFrame) -> DataFrame:
    return rates(games.where(~F.col("played"))).select("match_id", "home", "away", "lh", "la")


def summary(f: DataFrame, top: int) -> DataFrame:
    """Win, draw, loss and marginals from two count distributions; the likeliest score is the pair of likeliest counts."""
    f = f.withColumns({"ph": S.poisson(F.col("lh"), top), "pa": S.poisson(F.col("la"), top)})
    f = f.withColumn("w", S.win_draw_loss(F.col("ph"), F.col("pa")))
    first = lambda c: F.array_position(F.transform(c, lambda x: F.round(x, 10)), F.array_max(F.transform(c, lambda x: F.round(x, 10)))) - 1
    xg = S.total(F.transform("ph", lambda x, i: x * i)) * S.total(F.col("pa"))
    scale = S.total(F.col("pa"))
    return f.select(
        "match_id", F.round(F.col("w")[2], 6).alias("home"), F.round(F.col("w")[1], 6).alias("draw"), F.round(F.col("w")[0], 6).alias("away"),
        F.round(xg, 5).alias("xg_home"), (first(F.col("ph")) * 100 + first(F.col("pa"))).cast("int").alias("likeliest"),
        F.round(F.col("ph")[0] * scale, 6).alias("home_0"), F.round((S.total(F.col("ph")) - S.total(F.slice("ph", 1, 3))) * scale, 6).alias("home_3"),
    )


LOW = ((0, 0), (0, 1), (1, 0), (1, 1))


def corrected(f: DataFrame, top: int, rho: float, least: float = 1e-4) -> DataFrame:
    """Win, draw, loss with the low-score correction, and the number of cells above `least`.

    Four cells differ from the product of the two distributions: they are added to the sums of the plain product, of which no grid
    is built. The correction leaves the total as it is but for its floor.
    """
    f = f.withColumns({"ph": S.poisson(F.col("lh"), top), "pa": S.poisson(F.col("la"), top)})
    plain = lambda h, a: F.col("ph")[h] * F.col("pa")[a]
    factor = lambda h, a: S.dixon_coles(F.col("lh"), F.col("la"), F.lit(rho), F.lit(h), F.lit(a))
    f = f.withColumns({"w": S.win_draw_loss(F.col("ph"), F.col("pa")), "more": F.array(*[plain(h, a) * (factor(h, a) - 1) for h, a in LOW])})
    more = {0: F.col("more")[1], 1: F.col("more")[0] + F.col("more")[3], 2: F.col("more")[2]}  # away, draw, home
    f = f.withColumn("q", F.array(*[F.col("w")[k] + more[k] for k in range(3)]))
    f = f.withColumn("t", S.total(F.col("q")))
    f = f.withColumn("limit", F.lit(least) * F.col("t"))
    row = lambda x: F.size(F.filter("pa", lambda y: x * y > F.col("limit")))
    cells = F.aggregate("ph", F.lit(0), lambda n, x: n + row(x))
    for k, (h, a) in enumerate(LOW):
        cells = cells + (plain(h, a) + F.col("more")[k] > F.col("limit")).cast("int") - (plain(h, a) > F.col("limit")).cast("int")
    share = lambda k: F.round(F.col("q")[k] / F.col("t"), 6)
    return f.select("match_id", share(2).alias("home"), share(1).alias("draw"), share(0).alias("away"), cells.cast("long").alias("cells"))


def rho_likelihood(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Log-likelihood of the correction at every rho of a grid: one aggregate, a column for each rho."""
    ll = lambda r: F.sum(F.ln(S.dixon_coles(F.col("lh"), F.col("la"), F.lit(r), F.col("hg"), F.col("ag"))))
    one = scored.where("hg <= 1 and ag <= 1").agg(*[ll(r).alias(f"r{k}") for k, r in enumerate(grid)])  # other scores add 0
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rho"), F.coalesce(f"r{k}", F.lit(0.0)).alias("ll")) for k, r in enumerate(grid)])).alias("x"))
    return rows.select(F.round("x.rho", 2).alias("rho"), F.round("x.ll", 4).alias("ll"))


def rho_bounds(scored: DataFrame) -> tuple[float, float]:
    """The rho for which all four corrected cells stay positive at the rates at hand."""
    a, b = F.max(F.greatest("lh", "la")), F.max(F.col("lh") * F.col("la"))
    rate, product = scored.agg(a, b).first()
    return (-1 / rate if rate else -1.0), min(1.0, 1 / product if product else 1.0)


def fit_rho(scored: DataFrame, tolerance: float = 1e-6, wide: int = 24) -> float:
    """The rho of largest likelihood inside its bounds: each scan of the low scores narrows the bracket to a twelfth."""
    low, high = rho_bounds(scored)
    few = scored.where("hg <= 1 and ag <= 1").select("lh", "la", "hg", "ag")
    while high - low > tolerance:
        at = [low + (high - low) * k / wide for k in range(wide + 1)]
        ll = lambda r: F.sum(F.ln(S.dixon_coles(F.col("lh"), F.col("la"), F.lit(r), F.col("hg"), F.col("ag"))))
        got = few.agg(*[ll(r) for r in at]).first()
        if got[0] is None:
            return 0.0
        k = max(range(wide + 1), key=lambda i: got[i])
        low, high = at[max(k - 1, 0)], at[min(k + 1, wide)]
    return (low + high) / 2


def match_bands(rows: DataFrame, top: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Forecasts of (key, lh, la), arrays of rates by draw: mean and band over draws of home win, draw, away win and of 0, 1, 2 and 3 or
    more home goals, and the mean of expected goals. All draws of a match stand in one row, so nothing is shuffled."""
    rows = dealt(rows, "key")
    each = F.arrays_zip(F.col("lh"), F.col("la"))
    one = lambda d: S.let(F.struct(S.poisson(d["lh"], top).alias("h"), S.poisson(d["la"], top).alias("a")), _measures)
    rows = rows.withColumn("m", F.transform(each, one))
    names = ("away", "draw", "home", "goals_0", "goals_1", "goals_2", "goals_3")
    values = {n: F.array_sort(F.transform("m", _item(k))) for k, n in enumerate(names)}
    rows = rows.withColumns({f"_{n}": v for n, v in values.items()})
    out = []
    for n in names:
        c = F.col(f"_{n}")
        out += [S.quantile(c, low).alias(f"{n}_low"), (S.total(c) / F.size(c)).alias(f"{n}_mid"), S.quantile(c, high).alias(f"{n}_up")]
    xg = S.total(F.col("lh")) / F.size("lh")
    return rows.select("key", *out, xg.alias("xg_home"))


def _item(k: int):
    return lambda x: x[k]


def _measures(p):
    w = S.win_draw_loss(p["h"], p["a"])
    scale = S.total(p["a"])
    first = [p["h"][k] * scale for k in range(3)]
    return F.concat(w, F.array(*first, (S.total(p["h"]) * scale) - first[0] - first[1] - first[2]))


def ordered_bands(draws: DataFrame, cuts: list[float], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Class probabilities of every key over draws with the same cut points: median and band."""
    return _bands(draws.select("key", F.transform("beta", lambda eta: S.ordered_logit(eta, F.array(*map(F.lit, cuts)))).alias("p")), len(cuts) + 1, low, high)


def player_bands(draws: DataFrame, offset: float, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Class probabilities of (key, eta, deltas), by draw a predictor and the raw steps between cut points: the first cut point is the
    offset, each further one lies a softplus above the one before."""
    def one(d):
        upto = lambda k: F.aggregate(F.slice(d["deltas"], 1, k), F.lit(0.0), lambda s, x: s + S.softplus(x))
        cuts = F.transform(F.sequence(F.lit(0), F.size(d["deltas"])), lambda k: F.lit(offset) + F.when(k > 0, upto(F.greatest(k, F.lit(1)))).otherwise(0.0))
        return S.let(cuts, lambda c: S.ordered_logit(d["eta"], c))

    p = F.transform(F.arrays_zip(F.col("eta"), F.col("deltas")), one)
    return _bands(dealt(draws, "key").select("key", p.alias("p")), 4, low, high)


def _bands(rows: DataFrame, classes: int, low: float, high: float) -> DataFrame:
    """Median and band by class of (key, p), p the class probabilities by draw; draws are sorted inside their row."""
    sorted_ = [F.array_sort(F.transform("p", _item(k))) for k in range(classes)]
    rows = rows.withColumns({f"_{k}": v for k, v in enumerate(sorted_)})
    band = lambda k: F.struct(F.lit(k).alias("class"), *[F.round(S.quantile(F.col(f"_{k}"), q), 6).alias(n) for n, q in (("low", low), ("mid", 0.5), ("up", high))])
    return rows.select("key", F.explode(F.array(*[band(k) for k in range(classes)])).alias("b")).select("key", "b.*")


def hyper(draws: DataFrame) -> DataFrame:
    """Mean and deviation over keys by draw: (draw, mean, sd)."""
    e = draws.select(F.posexplode("beta").alias("draw", "v"))
    return e.groupBy("draw").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def unseen(by_draw: DataFrame, n: int, offset: float, seed: int | None = None) -> DataFrame:
    """Predictive class probabilities of n unseen keys from (draw, mean, sd), the hyper-parameters by draw: fresh normal effects that
    sum to zero over the keys of a draw, and fresh steps between cut points. Without a seed the normal numbers are hashes."""
    keys = by_draw.sparkSession.range(n).select(F.col("id").alias("key"))
    rows = keys.crossJoin(F.broadcast(by_draw))  # one row per draw
    z = lambda k: F.randn(seed + k) if seed is not None else S.normal(F.col("key"), F.col("draw"), k)
    rows = rows.withColumns({"e": z(0) * F.col("sd"), "d1": F.col("mean") + F.col("sd") * z(1), "d2": F.col("mean") + F.col("sd") * z(2)})
    centre = F.avg("e").over(Window.partitionBy("draw"))
    rows = rows.withColumn("eta", F.col("mean") + F.col("e") - centre)
    by = F.array_sort(F.collect_list(F.struct("draw", "eta", F.array("d1", "d2").alias("deltas"))))  # as many numbers a key as draws
    rows = rows.groupBy("key").agg(by.alias("x"))
    return player_bands(rows.select("key", F.transform("x", lambda x: x["eta"]).alias("eta"), F.transform("x", lambda x: x["deltas"]).alias("deltas")), offset)


def _middle_residuals(by_draw: list[list[float | None]]):
    """Blocks of (player, y, x0, x1, ...) -> the median over draws of y less the dot product of the factors and a draw's coefficients, null where
    a factor or y is. Draws without all coefficients have no residual and come last, as nulls do."""
    beta = np.array([b for b in by_draw if None not in b], float)
    at = (len(by_draw) - 1) * 0.5
    low = math.floor(at)
    high, step = min(low + 1, len(by_draw) - 1), max(1, CELLS // max(1, len(by_draw)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            y, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            none = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=0)
            mid = np.full(b.num_rows, np.nan)
            if high < len(beta):
                eta = np.zeros((b.num_rows, len(beta)))
                for k, v in enumerate(x):
                    eta += v[:, None] * beta[:, k]
                r = np.sort(y[:, None] - eta, axis=1)
                mid = r[:, low] + (r[:, high] - r[:, low]) * (at - low)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mid, mask=none | (high >= len(beta)))], names=["player", "r"])

    return run


def above_replacement(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Share of the other players whose mean residual is at most a player's own: rows (player, y, x), x an array of factors, and one row
    `by_draw` of coefficient arrays. Residuals take the median over draws inside a block of rows, then the mean by player."""
    one = coefficients.select("by_draw").first()
    by_draw = one["by_draw"] if one else []
    k = len(by_draw[0]) if by_draw else 0
    factors = [F.when(F.size("x") == k, F.get("x", F.lit(i))).cast("double").alias(f"x{i}") for i in range(k)]
    rows = (rows if one else rows.limit(0)).select("player", F.col("y").cast("double").alias("y"), *factors)
    rows = rows.mapInArrow(_middle_residuals(by_draw), StructType([rows.schema["player"], StructField("r", DoubleType())]))
    by = rows.groupBy("player").agg(F.round(F.avg("r"), 9).alias("delta"))
    counts = running(by.groupBy("delta").agg(F.count("*").alias("n")), "delta", ["n"], totals=True)
    share = F.try_divide(F.col("n_sum") - 1, F.col("n_all") - 1)
    return by.join(counts, "delta").select("player", "delta", share.alias("par"))


def skill_board(draws: DataFrame, n: int) -> DataFrame:
    """Above-average effect of each key by draw (its mean less the draw's overall mean): mean and band. Arrays of n draws stay arrays."""
    by = sums_of(draws, ["key"], ["beta"], n)
    p = against_all(by, sums_of(draws, [], ["beta"], n), ["beta"]).withColumnRenamed("beta", "par")
    p = p.join(by.select("key", F.transform("beta", lambda x: x / F.col("n")).alias("sar")), "key")
    return p.select("key", *banded("par", "par"), F.round(S.total(F.col("sar")) / F.size("sar"), 6).alias("sar_mid"))


def newcomer_anchor(draws: DataFrame) -> DataFrame:
    """Median by key, its empirical distribution from counts by distinct median, and the lower quartile of the medians."""
    m = draws.select("key", "factor", S.quantile(F.array_sort("beta"), 0.5).alias("med"))
    by = m.groupBy("med").agg(F.count("*").alias("n"))
    by = running(by, "med", ["n"], totals=True)
    ecdf = F.col("n_sum") / F.col("n_all")
    low = quantiles(m, "med", [0.25]).select(F.col("q0").alias("newcomer"))
    return m.join(by.select("med", ecdf.alias("ecdf")), "med").crossJoin(F.broadcast(low)).select(
        "key", "factor", F.round("med", 6).alias("med"), F.round("ecdf", 6).alias("ecdf"), F.round("newcomer", 6).alias("newcomer")
    )


def cumulative(rows: DataFrame, columns: dict[str, str], top: int = 11) -> DataFrame:
    """Distribution functions F(0), ..., F(top) of Poisson counts as arrays, one for each rate: {rate: name}."""
    rows = rows.withColumns({f"_{n}": S.poisson(F.col(r), top) for r, n in columns.items()})
    upto = lambda n: F.transform(F.sequence(F.lit(1), F.lit(top + 1)), lambda k: S.total(F.slice(f"_{n}", 1, k)))
    return rows.withColumns({n: upto(n) for n in columns.values()}).drop(*[f"_{n}" for n in columns.values()])


def replicates(rated: DataFrame, draws: int, seed: int | None = None, top: int = 11) -> DataFrame:
    """Predictive draws of the scores of rated matches: their columns with draw, h and a.

    A count is the number of F(0), ..., F(top) below a uniform number. All of it is plain columns and comparisons, which Spark compiles;
    arrays and their lambdas would be interpreted for each draw.
    """
    sides, ks = {"h": "lh", "a": "la"}, range(top + 1)
    p = lambda r, k: F.exp(F.lit(k) * F.ln(r) - F.col(r)) / math.factorial(k)
    rows = dealt(rated, "match_id").withColumns({f"_p{n}{k}": p(r, k) for n, r in sides.items() for k in ks})
    upto = lambda n, k: sum((F.col(f"_p{n}{j}") for j in range(1, k + 1)), F.col(f"_p{n}0"))
    rows = rows.select(*rated.columns, *[upto(n, k).alias(f"_c{n}{k}") for n in sides for k in ks])
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = [F.rand(seed + i) if seed is not None else S.uniform(F.col("match_id") * 2 + i, F.col("draw")) for i in (0, 1)]
    rows = rows.withColumns({f"_u{n}": x for n, x in zip(sides, u, strict=True)})
    below = lambda n: sum((F.when(F.col(f"_c{n}{k}") < F.col(f"_u{n}"), 1).otherwise(0) for k in ks), F.lit(0)).cast("long")
    return rows.select(*rated.columns, "draw", *[below(n).alias(n) for n in sides])


def rootogram(rated: DataFrame, drawn: DataFrame, top: int, draws: int) -> DataFrame:
    """How often sides score 0..top goals, observed and over predictive draws (mean and 94 % band); other counts are left out."""
    times = lambda x, y, k: F.count_if(F.col(x) == k) + F.count_if(F.col(y) == k)
    seen = rated.agg(*[times("hg", "ag", k).alias(f"o{k}") for k in range(top + 1)])
    scores = drawn.groupBy("draw", "h", "a").agg(F.count("*").alias("n"))  # a row a draw and score
    here = lambda k: F.sum(F.col("n") * ((F.col("h") == k).cast("long") + (F.col("a") == k).cast("long")))
    by = scores.groupBy("draw").agg(*[here(k).alias(f"k{k}") for k in range(top + 1)])
    rows = by.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n")) for k in range(top + 1)])).alias("x")).select("x.*")  # top + 1 rows a draw
    rows = rows.groupBy("k").agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.03)).alias("low"), F.percentile("n", F.lit(0.97)).alias("high"))
    one = F.element_at(F.array(*[F.col(f"o{k}") for k in range(top + 1)]), F.col("k") + 1)
    return rows.crossJoin(F.broadcast(seen)).select("k", one.alias("observed"), "mean", "low", "high")


def scorelines(rated: DataFrame, drawn: DataFrame, lines: list[tuple[int, int]]) -> DataFrame:
    """Share of some scores, observed and over predictive draws."""
    share = lambda x, y, h, a: F.avg(((F.col(x) == h) & (F.col(y) == a)).cast("double"))
    one = rated.agg(*[share("hg", "ag", h, a).alias(f"o{k}") for k, (h, a) in enumerate(lines)])
    two = drawn.agg(*[share("h", "a", h, a).alias(f"p{k}") for k, (h, a) in enumerate(lines)])
    each = F.array(*[F.struct(F.lit(f"{h}-{a}").alias("score"), F.col(f"o{k}").alias("observed"), F.col(f"p{k}").alias("predicted")) for k, (h, a) in enumerate(lines)])
    return one.crossJoin(two).select(F.explode(each).alias("x")).select("x.*", (F.col("x.observed") - F.col("x.predicted")).alias("difference"))


def draw_calibration(rated: DataFrame, drawn: DataFrame, group: str) -> DataFrame:
    """Share of draws by group, observed and over predictive draws with a 94 % band, and MISS where the band leaves it out."""
    seen = rated.groupBy(group).agg(F.avg((F.col("hg") == F.col("ag")).cast("double")).alias("observed"))
    by = drawn.groupBy(group, "draw").agg(F.avg((F.col("h") == F.col("a")).cast("double")).alias("p"))  # one number a group and draw
    band = by.groupBy(group).agg(F.avg("p").alias("predicted"), F.percentile("p", F.lit(0.03)).alias("low"), F.percentile("p", F.lit(0.97)).alias("high"))
    out = (F.col("observed") < F.col("low")) | (F.col("observed") > F.col("high"))
    return seen.join(band, group).withColumn("flag", F.when(out, "MISS").otherwise("ok"))


def _uniforms(rows: np.ndarray, draws: int, seed: int | None) -> np.ndarray:
    """(rows, draws) uniform numbers that belong to a row and draw, whichever task asks for them; without a seed those of S.uniform."""
    if seed is None:
        return ((rows[:, None].astype(np.int64) * 7919 + np.arange(draws) * 104729) % 100003 + 0.5) / 100003
    return np.array([np.random.default_rng([seed, int(r) & (1 << 63) - 1]).random(draws) for r in rows]).reshape(len(rows), draws)


def _results(draws: int, seed: int | None):
    """Sides of matches with both distribution functions -> points and goal difference by draw."""

    def make(b) -> list[np.ndarray]:
        match, home = b.column("match_id").to_numpy(), b.column("at_home").to_numpy(zero_copy_only=False)[:, None]
        goals = [(matrix(b, c)[:, :, None] < _uniforms(match * 2 + i, draws, seed)[:, None]).sum(axis=1) for i, c in enumerate(("_ch", "_ca"))]
        mine, other = np.where(home, goals[0], goals[1]), np.where(home, goals[1], goals[0])
        return [3.0 * (mine > other) + (mine == other), (mine - other).astype(float)]

    return make


def _placed(draws: int, relegated: int, seed: int | None):
    """The teams of a league and season with what they have and what each draw adds -> chances of places, points with a band."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        added = lambda c: np.array([np.zeros(draws) if x is None else x for x in t[c]])
        team = t.team.to_numpy()
        pts, gd = t.pts.to_numpy()[:, None] + added("more_pts"), t.gd.to_numpy()[:, None] + added("more_gd")
        if seed is None:
            lot = ((team[:, None] + 31 * np.arange(draws)) * 7919 + team[:, None] * 104729) % 100003
        else:
            lot = _uniforms(team, draws, seed + 2)
        place = np.empty((len(team), draws), int)
        for d in range(draws):
            place[np.lexsort((team, lot[:, d], -gd[:, d], -pts[:, d])), d] = np.arange(1, len(team) + 1)
        share = lambda x: x.mean(axis=1).round(6)
        low, high = np.quantile(pts, [0.05, 0.95], axis=1)
        return pd.DataFrame(
            {
                "league": t.league, "season": t.season, "team": team, "title": share(place == 1), "top4": share(place <= 4), "relegated": share(place > len(team) - relegated),
                "points": share(pts), "low": low.round(6), "high": high.round(6),
            }
        )

    return run


def season_odds(games: DataFrame, fixtures: DataFrame, draws: int, relegated: int = 3, seed: int | None = None) -> DataFrame:
    """Monte Carlo over the rest of every league and season: played matches are pinned, the others drawn; ranks by points, goal
    difference, then lots drawn for each draw (a hash of team and draw unless there is a seed).

    A match's draws are an array, of which tasks keep sums by team; a league's teams, a few dozen, are then ranked together in all draws.
    """
    key = ["league", "season"]
    played = games.where("hg is not null")
    side = lambda team, x, y: played.select(*key, F.col(team).alias("team"), match_points(F.col(x), F.col(y)).alias("pts"), (F.col(x) - F.col(y)).alias("gd"))
    past = side("home", "hg", "ag").union(side("away", "ag", "hg")).groupBy(*key, "team").agg(F.sum("pts").cast("long").alias("pts"), F.sum("gd").cast("long").alias("gd"))
    left = cumulative(dealt(fixtures.select(*key, "match_id", "home", "away", "lh", "la"), "match_id"), {"lh": "_ch", "la": "_ca"})
    sides = F.explode(F.array(*[F.struct(F.col(t).alias("team"), F.lit(t == "home").alias("at_home")) for t in ("home", "away")])).alias("s")
    rows = left.select(*key, "match_id", "_ch", "_ca", sides).select(*key, "match_id", "_ch", "_ca", "s.*")
    more = summed(rows, [*key, "team"], ["match_id", "_ch", "_ca", "at_home"], ["more_pts", "more_gd"], _results(draws, seed), 12 * draws)
    table = past.join(more.drop("n"), [*key, "team"], "left")
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in (*key, "team"))
    out = kinds + ", title double, top4 double, relegated double, points double, low double, high double"
    return table.groupBy(*key).applyInPandas(_placed(draws, relegated, seed), out)
