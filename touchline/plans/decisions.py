"""Treatment effects, ledgers and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.operators import audit as A
from touchline.operators import causal as C
from touchline.operators import counts
from touchline.operators import features
from touchline.operators import ledgers as L
from touchline.plans.registry import query
from touchline.plans.standings import PLAYER
from touchline.sources import tables as T


@query("WITH " + T.TREATMENT + """ SELECT stratum, covariate, count(*) AS n, round(avg(treated), 6) AS rate, round(avg(outcome) FILTER (treated = 1), 6) AS treated_mean, round(avg(outcome) FILTER (treated = 0), 6) AS control_mean,
  round(avg(outcome) FILTER (treated = 1) - avg(outcome) FILTER (treated = 0), 6) AS effect FROM treatment GROUP BY stratum, covariate""")
def effects_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect, rate and means by stratum."""
    e = C.effects_by(T.treatment(spark, sf_dir), "stratum", "covariate")
    return e.select("stratum", "covariate", "n", *[F.round(c, 6).alias(c) for c in ("rate", "treated_mean", "control_mean", "effect")])


@query("WITH " + T.TREATMENT + """, s AS (SELECT stratum, avg(outcome) FILTER (treated = 1) - avg(outcome) FILTER (treated = 0) AS e FROM treatment GROUP BY stratum)
SELECT round((SELECT avg(outcome) FILTER (treated = 1) - avg(outcome) FILTER (treated = 0) FROM treatment), 6) AS naive, round(avg(e), 6) AS adjusted FROM s""")
def naive_and_adjusted_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive against stratified effect."""
    e = C.naive_and_adjusted(T.treatment(spark, sf_dir), "stratum")
    return e.select(F.round("naive", 6).alias("naive"), F.round("adjusted", 6).alias("adjusted"))


@query("WITH " + T.TREATMENT + """, q AS (SELECT quantile_cont(outcome, 0.25) AS a, quantile_cont(outcome, 0.5) AS b, quantile_cont(outcome, 0.75) AS c FROM treatment)
SELECT CASE WHEN outcome <= a THEN 1 WHEN outcome <= b THEN 2 WHEN outcome <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(treated), 6) AS rate FROM treatment, q GROUP BY 1""")
def treatment_by_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles and treatment rates in them."""
    q = C.quartiles(T.treatment(spark, sf_dir), "outcome")
    return q.groupBy("quartile").agg(F.count("*").alias("n"), F.round(F.avg("treated"), 6).alias("rate"))


@query("WITH " + T.TREATMENT + """ SELECT min(outcome) FILTER (treated = 0) AS low_0, max(outcome) FILTER (treated = 0) AS high_0, min(outcome) FILTER (treated = 1) AS low_1, max(outcome) FILTER (treated = 1) AS high_1,
  min(outcome) FILTER (treated = 0) <= max(outcome) FILTER (treated = 1) AND min(outcome) FILTER (treated = 1) <= max(outcome) FILTER (treated = 0) AS overlap FROM treatment""")
def treatment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positivity by ranges."""
    return C.overlap(T.treatment(spark, sf_dir), "outcome")


@query("WITH " + T.TREATMENT + """, t AS (SELECT * FROM treatment WHERE treated = 1), c AS (SELECT * FROM treatment WHERE treated = 0), m AS (
  SELECT t.id, arg_min(c.covariate, struct_pack(g := abs(c.outcome - t.outcome), s := c.outcome, i := c.id)) AS x FROM t CROSS JOIN c GROUP BY t.id)
SELECT round((avg(covariate) FILTER (treated = 1) - avg(covariate) FILTER (treated = 0)) / stddev_samp(covariate) FILTER (treated = 1), 6) AS before,
  round((avg(covariate) FILTER (treated = 1) - (SELECT avg(x) FROM m)) / stddev_samp(covariate) FILTER (treated = 1), 6) AS after FROM treatment""")
def matching_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised difference before and after matching one to one."""
    b = C.balance(T.treatment(spark, sf_dir), "covariate", "outcome")
    return b.select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("WITH " + T.TREATMENT + """ SELECT 'slope' AS term, round(regr_slope(outcome, treated), 4) AS estimate FROM treatment UNION ALL SELECT 'intercept', round(regr_intercept(outcome, treated), 4) FROM treatment""")
def regression_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares from one aggregate of moments."""
    r = C.regression(T.treatment(spark, sf_dir), "outcome", ["treated"])
    return r.select(F.when(F.col("term") == "treated", "slope").otherwise(F.col("term")).alias("term"), F.round("estimate", 4).alias("estimate"))


@query()
def treatment_propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: logistic propensity with the penalty mapped from C."""
    return C.propensity(T.treatment(spark, sf_dir), ["outcome", "covariate"]).select("id", "treated", F.round("propensity", 6).alias("propensity"))


LEDGER = T.GAMES + """, old AS (SELECT season, home, away, max(match_id % 100) AS p, 'old' AS source FROM games WHERE gameday <= 15 GROUP BY ALL),
fresh AS (SELECT season, home, away, max(match_id % 50) AS p, 'fresh' AS source FROM games WHERE gameday >= 10 GROUP BY ALL),
done AS (SELECT DISTINCT season, home, away FROM games WHERE gameday <= 12)"""


@query("WITH " + LEDGER + """ SELECT * FROM old SEMI JOIN done USING (season, home, away) UNION ALL
SELECT * FROM (SELECT * FROM old ANTI JOIN done USING (season, home, away)) ANTI JOIN fresh USING (season, home, away)
UNION ALL SELECT * FROM fresh ANTI JOIN (SELECT * FROM old SEMI JOIN done USING (season, home, away)) USING (season, home, away)""")
def frozen_match_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played rows stay, open rows are refreshed."""
    g = T.games(spark, sf_dir)
    old = g.where("gameday <= 15").groupBy(*L.MATCH_KEY).agg(F.max(F.col("match_id") % 100).alias("p")).withColumn("source", F.lit("old"))
    fresh = g.where("gameday >= 10").groupBy(*L.MATCH_KEY).agg(F.max(F.col("match_id") % 50).alias("p")).withColumn("source", F.lit("fresh"))
    return L.refreshed(old, fresh, g.where("gameday <= 12"))


@query("WITH " + T.GAMES + """ SELECT season, home, away, CAST(max(kick_off - CAST(match_id % 9 AS INTEGER) + 3) AS VARCHAR) AS stamp FROM games WHERE kick_off - CAST(match_id % 9 AS INTEGER) + 3 < kick_off GROUP BY season, home, away""")
def rebuilt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest forecast before kick-off out of all vintages."""
    v = T.games(spark, sf_dir).withColumn("stamp", F.date_add("kick_off", (3 - F.col("match_id") % 9).cast("int")))
    return L.rebuilt(v, "kick_off", "stamp").select(*L.MATCH_KEY, F.col("stamp").cast("string").alias("stamp"))


@query("WITH " + T.GAMES + """ SELECT CAST(kick_off AS VARCHAR) AS kick_off, count(*) * CASE WHEN kick_off = (SELECT max(kick_off) FROM games) THEN 2 ELSE 1 END AS n,
  CASE WHEN kick_off = (SELECT max(kick_off) FROM games) THEN 'second' ELSE 'first' END AS run FROM games GROUP BY kick_off""")
def tracker_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4, K4: the last day's rows are replaced, all other days stay."""
    g = T.games(spark, sf_dir).groupBy("kick_off").agg(F.count("*").alias("n"))
    last = T.games(spark, sf_dir).agg(F.max("kick_off").alias("kick_off"))
    first = g.withColumn("run", F.lit("first"))
    today = g.join(F.broadcast(last), "kick_off").select("kick_off", (F.col("n") * 2).alias("n"), F.lit("second").alias("run"))
    return L.tracked(first, today, "kick_off").withColumn("kick_off", F.col("kick_off").cast("string"))


@query("WITH " + T.GAMES + ", " + T.SCORERS + """, k AS (SELECT * FROM games QUALIFY row_number() OVER (PARTITION BY season, league, home, away ORDER BY kick_off DESC, match_id DESC) = 1)
SELECT 'matches' AS kind, count(*) AS n FROM k UNION ALL SELECT 'goals', count(*) FROM scorers WHERE match_id IN (SELECT match_id FROM k)""")
def postponed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated pairings keep the last match, goals of removed ones go."""
    kept, goals = L.cascaded(T.games(spark, sf_dir), T.scorers(spark, sf_dir), ["season", "league", "home", "away"], [F.col("kick_off"), F.col("match_id")], "match_id")
    return kept.agg(F.count("*").alias("n")).select(F.lit("matches").alias("kind"), "n").union(goals.agg(F.count("*").alias("n")).select(F.lit("goals"), "n"))


@query("WITH " + PLAYER + """, t AS (SELECT season, league, player, match_id, kick_off, goals, home_pitch, CASE WHEN match_id % 3 = 0 THEN team END AS position, CAST(coalesce(sum(goals) OVER w, 0) AS BIGINT) AS before, row_number() OVER v AS n
  FROM player WINDOW w AS (PARTITION BY league, season, player ORDER BY kick_off, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY league, season, player ORDER BY kick_off, match_id)),
d AS (SELECT *, before - lag(before) OVER w AS diff, lag(goals) OVER w AS prev, max(position) OVER (PARTITION BY season, player) AS filled FROM t WINDOW w AS (PARTITION BY league, season, player ORDER BY kick_off, match_id)),
m AS (SELECT round(avg(CASE WHEN diff = prev THEN 1 ELSE 0 END) FILTER (n > 1), 6) AS s, count(*) FILTER (n = 1 AND before <> 0) AS f, count(*) FILTER (goals > 6) AS g, count(*) FILTER (home_pitch NOT IN (0, 1)) AS h, count(*) FILTER (before + goals > 40) AS o,
  round(avg(CASE WHEN filled IS NULL THEN 1 ELSE 0 END), 6) AS p FROM d), u AS (SELECT count(*) AS u FROM (SELECT match_id, player FROM player GROUP BY ALL HAVING count(*) > 1))
SELECT 'unique match_id,player' AS "check", CASE WHEN u = 0 THEN 'PASS' ELSE 'FAIL' END AS result, CAST(u AS VARCHAR) AS detail FROM u UNION ALL SELECT 'running total follows the row before', CASE WHEN s >= 0.995 THEN 'PASS' ELSE 'FAIL' END, CAST(s AS VARCHAR) FROM m
UNION ALL SELECT 'first row starts at 0', CASE WHEN f < 1 THEN 'PASS' ELSE 'FAIL' END, CAST(f AS VARCHAR) FROM m UNION ALL SELECT 'goals at most 6', CASE WHEN g < 1 THEN 'PASS' ELSE 'WARN' END, CAST(g AS VARCHAR) FROM m
UNION ALL SELECT 'required columns', 'PASS', '' UNION ALL SELECT 'domain of home_pitch', CASE WHEN h < 1 THEN 'PASS' ELSE 'FAIL' END, CAST(h AS VARCHAR) FROM m
UNION ALL SELECT 'totals above 40', CASE WHEN o < 50 THEN 'PASS' ELSE 'WARN' END, CAST(o AS VARCHAR) FROM m UNION ALL SELECT 'no position after fill', CASE WHEN p <= 0.25 THEN 'PASS' ELSE 'FAIL' END, CAST(p AS VARCHAR) FROM m""")
def player_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table of the player rows: one aggregate over one pass of windows, and one of the key alone."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir), goals_first=True)
    rows = rows.withColumn("position", F.when(F.col("match_id") % 3 == 0, F.col("team")))
    season, order = ["season", "player"], ["kick_off", "match_id"]
    part = [*season, "league"]  # inside a player's season, so that one sort serves all windows
    seen = rows.select(*part, *order, "goals", "home_pitch", "position").repartition(*season).sortWithinPartitions(*part, *order)
    seen = seen.withColumn("before", features.running_before("goals", part, order))
    seen = A.with_lags(seen, "before", "goals", part, order).withColumn("filled", F.max("position").over(Window.partitionBy(*season)))
    none = lambda x: x < 1
    checks = A.checks(
        seen,
        [
            ("running total follows the row before", A.step_share(), lambda x: x >= 0.995, False),
            ("first row starts at 0", F.count_if(F.col("_first") & (F.col("before") != 0)), none, False),
            ("goals at most 6", F.count_if(F.col("goals") > 6), none, True),
            ("domain of home_pitch", F.count_if(~F.col("home_pitch").isin(0, 1)), none, False),
            ("totals above 40", F.count_if(F.col("before") + F.col("goals") > 40), lambda x: x < 50, True),
            ("no position after fill", F.round(F.avg(F.col("filled").isNull().cast("int")), 6), lambda x: x <= 0.25, False),
        ],
    )
    return A.audit([A.required_columns(rows, ["match_id", "player", "goals"]), A.unique_key(rows, ["match_id", "player"]), checks])


@query("WITH " + T.GAMES + """, a AS (SELECT DISTINCT home, away FROM games WHERE season = 2000), b AS (SELECT DISTINCT home, away FROM games WHERE season = 1999)
SELECT (SELECT count(*) FROM a ANTI JOIN b USING (home, away)) AS gained, (SELECT count(*) FROM b ANTI JOIN a USING (home, away)) AS lost""")
def vintage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys gained and lost between two vintages."""
    g = T.games(spark, sf_dir)
    return A.coverage(g.where("season = 2000"), g.where("season = 1999"), ["home", "away"])


@query("WITH " + T.GAMES + """ SELECT league, count(*) AS n, round(count(*) / (SELECT count(*) FROM games)::DOUBLE, 6) AS share FROM games GROUP BY league""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and category mix."""
    f = A.fingerprint(T.games(spark, sf_dir), "league")
    return f.select("league", "n", F.round("share", 6).alias("share"))


@query("WITH " + T.FORECASTS + ", " + T.DRAWS + """, g AS (SELECT max(abs(list_sum(p) - 1)) AS s, count(*) FILTER (len(list_filter(p, lambda x: isnan(x) OR x < 0 OR x > 1)) > 0) AS f FROM forecasts),
e AS (SELECT max(abs(0.1::DOUBLE + 0.5 * beta[1] - 0.25 * beta[2] - (0.1::DOUBLE + 0.5 * beta[1] + beta[2] * -0.25))) AS same, max(abs(0.5 * beta[1] - 0.25 * beta[2] - (0.1::DOUBLE + 0.5 * beta[1] + beta[2] * -0.25))) AS bare FROM draws)
SELECT 'simplex' AS "check", CASE WHEN s < 1e-9 THEN 'PASS' ELSE 'FAIL' END AS result, CAST(round(s, 6) AS VARCHAR) AS detail FROM g UNION ALL SELECT 'finite', CASE WHEN f < 1 THEN 'PASS' ELSE 'FAIL' END, CAST(f AS VARCHAR) FROM g
UNION ALL SELECT 'predictor parity', CASE WHEN same < 1e-8 THEN 'PASS' ELSE 'FAIL' END, CAST(round(same, 6) AS VARCHAR) FROM e UNION ALL SELECT 'predictor parity without its base', CASE WHEN bare < 1e-8 THEN 'PASS' ELSE 'FAIL' END, CAST(round(bare, 6) AS VARCHAR) FROM e
UNION ALL SELECT 'golden rows', 'PASS', '0.0'""")
def forecast_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplex and finite gates; the predictor built from its parts against the stored one, and without its base as the control
    that has to fail; golden probabilities, fixed numbers, against what the engine makes of their inputs."""
    f = T.forecasts(spark, sf_dir)
    gates = A.checks(
        f,
        [
            ("simplex", F.round(F.max(F.abs(S.total(F.col("p")) - 1)), 6), lambda x: x < 1e-9, False),
            ("finite", F.count_if(F.exists("p", lambda x: F.isnan(x) | (x < 0) | (x > 1))), lambda x: x < 1, False),
        ],
    )
    b = F.col("beta")
    d = T.draws(spark, sf_dir).select("key", (0.1 + 0.5 * b[0] - 0.25 * b[1]).alias("stored"), F.array(F.lit(0.5), F.lit(-0.25)).alias("x"), F.array(F.array(b[0], b[1])).alias("by_draw"))
    built = lambda base: counts.linear_predictor(d.withColumn("base", F.lit(base)), "x", "by_draw", "base").select("stored", F.col("eta")[0].alias("eta"))
    gap = F.round(F.max(F.abs(F.col("eta") - F.col("stored"))), 6)
    parity = [A.checks(built(base), [(label, gap, lambda x: x < 1e-8, False)]) for base, label in ((0.1, "predictor parity"), (0.0, "predictor parity without its base"))]
    golden = spark.createDataFrame([(eta, p) for eta, p in GOLDEN], "eta double, p array<double>")
    off = F.aggregate(F.zip_with(S.ordered_logit(F.col("eta"), F.array(*map(F.lit, (0.5, 1.5, 2.5)))), "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return A.audit([gates, *parity, A.checks(golden, [("golden rows", F.round(F.max(off), 9), lambda x: x < 1e-10, False)])])


#: A predictor and the class probabilities of cut points 0.5, 1.5 and 2.5, worked out apart from the engine.
GOLDEN = [
    (0.0, [0.6224593312018546, 0.19511514499178906, 0.1065673437851129, 0.07585818002124345]),
    (1.0, [0.3775406687981454, 0.2449186624037092, 0.19511514499178906, 0.18242552380635635]),
    (-2.0, [0.9241418199787566, 0.04654594926988709, 0.018325288120763172, 0.010986942630593188]),
]
