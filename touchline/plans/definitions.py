"""Features, scores and audit rules whose SQL follows their definition: ranks, products, dummies, curves, rules of adoption, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.operators import audit as A
from touchline.operators import causal, features, ratings
from touchline.operators import evaluation as E
from touchline.operators import ladder as L
from touchline.operators import scaling as Z
from touchline.plans.forecasting import REPS, elo_sql, replicated
from touchline.plans.registry import query
from touchline.plans.standings import FORM, FORM_ROWS, LADDER, PLAYER, PRIOR, ewma_sql
from touchline.sources import tables as T

RANKS = LADDER + """, prior_days AS (SELECT league, season, gameday, lag(gameday) OVER (PARTITION BY league, season ORDER BY gameday) AS prior FROM (SELECT DISTINCT league, season, gameday FROM ladder)),
ranks AS (SELECT a.league, a.season, a.gameday, a.team, any_value(a.gf) AS gf, count(*) - (count(*) FILTER (b.gf < a.gf) + (count(*) FILTER (b.gf = a.gf) + 1) / 2.0::DOUBLE) AS scored, count(*) FILTER (b.ga < a.ga) + (count(*) FILTER (b.ga = a.ga) + 1) / 2.0::DOUBLE AS conceded
  FROM ladder a JOIN ladder b USING (league, season, gameday) GROUP BY a.league, a.season, a.gameday, a.team)"""


@query("WITH " + RANKS + """ SELECT s.match_id, s.home_pitch, coalesce(o.conceded, 0) - coalesce(t.scored, 0) AS goal_appeal, coalesce(t.scored, 0) - coalesce(o.scored, 0) AS scored_rank_diff
FROM sides s LEFT JOIN prior_days d USING (league, season, gameday) LEFT JOIN ranks t ON t.league = s.league AND t.season = s.season AND t.gameday = d.prior AND t.team = s.team
LEFT JOIN ranks o ON o.league = s.league AND o.season = s.season AND o.gameday = d.prior AND o.team = s.opp""")
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal appeal and rank differences from the ranks before the match."""
    rows = features.rank_differences(features.pre_match_ranks(T.sides(T.games(spark, sf_dir))))
    return rows.select("match_id", "home_pitch", "goal_appeal", "scored_rank_diff")


@query("WITH " + RANKS + ", " + PLAYER.removeprefix(T.GAMES + ", ") + """, own AS (SELECT *, coalesce(sum(goals) OVER (PARTITION BY league, season, team, player ORDER BY gameday RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM player),
w AS (SELECT p.match_id, p.player, t.scored AS team, t.scored - coalesce(o.scored, 0) AS diff,
  (SELECT count(*) FROM ranks x WHERE x.league = p.league AND x.season = p.season AND x.gameday = d.prior) - ((SELECT count(*) FROM ranks x WHERE x.league = p.league AND x.season = p.season AND x.gameday = d.prior AND x.team <> p.team AND x.gf < t.gf - p.before)
   + ((SELECT count(*) FROM ranks x WHERE x.league = p.league AND x.season = p.season AND x.gameday = d.prior AND x.team <> p.team AND x.gf = t.gf - p.before) + 2) / 2.0::DOUBLE) - coalesce(o.scored, 0) AS without
  FROM own p JOIN prior_days d USING (league, season, gameday) JOIN ranks t ON t.league = p.league AND t.season = p.season AND t.gameday = d.prior AND t.team = p.team
  JOIN games g ON g.match_id = p.match_id LEFT JOIN ranks o ON o.league = p.league AND o.season = p.season AND o.gameday = d.prior AND o.team = CASE WHEN p.home_pitch = 1 THEN g.away ELSE g.home END)
SELECT match_id, player, diff AS scored_rank_diff, without AS scored_rank_diff_without, diff - without AS scored_rank_diff_contribution FROM w""")
def player_rank_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank difference before a match with and without the player's own goals so far, for teams that have a standing."""
    games = T.games(spark, sf_dir)
    rows = features.player_goals(games, T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    opp = F.when(F.col("home_pitch") == 1, F.col("away")).otherwise(F.col("home"))
    before = Window.partitionBy(*L.KEYS, "team", "player").orderBy("gameday").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.select("match_id", "player", *L.KEYS, "gameday", "team", opp.alias("opp"), F.coalesce(F.sum("goals").over(before), F.lit(0)).alias("own"))
    table = L.ranked(L.ladder(T.sides(games)))
    rows = L.prior_standing(rows, table, ["scored_rank"], "_team", "team")
    rows = L.prior_standing(rows, table, ["scored_rank"], "_opp", "opp")
    now = L.before_day(table, ["gf"]).where("gf is not null")
    everybody = now.groupBy(*L.KEYS, "gameday").agg(F.collect_list("gf").alias("all"))  # the teams of a league
    rows = rows.join(now, [*L.KEYS, "gameday", "team"]).join(everybody, [*L.KEYS, "gameday"])
    rows = rows.withColumn("without", L.rank_without(F.col("gf") - F.col("own"), F.col("all"), F.col("gf")))
    out = features.without_player(features.rank_differences(rows.withColumn("conceded_rank_opp", F.lit(None).cast("double"))), "without")
    return out.select("match_id", "player", "scored_rank_diff", "scored_rank_diff_without", "scored_rank_diff_contribution")


@query("WITH RECURSIVE " + FORM + ", " + elo_sql("f") + f""", m AS (SELECT match_id, home_pitch, team, opp, {ewma_sql("points_team::DOUBLE", 1.0)} AS s, {ewma_sql("points_team::DOUBLE", 8.0)} AS l FROM form WINDOW {FORM_ROWS})
SELECT a.match_id, a.home_pitch, round(CASE WHEN a.home_pitch = 1 THEN e.home_elo - e.away_elo ELSE e.away_elo - e.home_elo END, 4) AS elo_diff, round(e.home_elo * e.away_elo / 1e6, 4) AS elo_team_opp,
  round(a.s * a.l, 4) AS team_short_long, round(b.s * b.l, 4) AS opp_short_long, round(a.s * b.s, 4) AS short_diff FROM m a JOIN m b ON b.match_id = a.match_id AND b.team = a.opp JOIN f e ON e.match_id = a.match_id""")
def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of ratings, of short and long momentum, and the product that goes by the name of a difference."""
    games = T.games(spark, sf_dir)
    rows, key, order = features.pre_match(T.sides(games)), ["league", "season", "team"], ["kick_off", "match_id", "home_pitch"]
    rows = features.ewmas(rows, "points_team", key, order, {"short_team": 1.0, "long_team": 8.0}).select("match_id", "home_pitch", "short_team", "long_team")
    rows = features.of_opponent(rows, {"short_team": "short_opp", "long_team": "long_opp"})
    elo = ratings.elo(games).select("match_id", "home_elo", "away_elo")
    home = F.col("home_pitch") == 1
    rows = rows.join(elo, "match_id").withColumns(
        {"elo_team": F.when(home, F.col("home_elo")).otherwise(F.col("away_elo")), "elo_opp": F.when(home, F.col("away_elo")).otherwise(F.col("home_elo"))}
    )
    out = features.interactions(rows).withColumn("elo_team_opp", F.col("elo_team_opp") / 1e6)
    return out.select("match_id", "home_pitch", *[F.round(c, 4).alias(c) for c in ("elo_diff", "elo_team_opp", "team_short_long", "opp_short_long", "short_diff")])


@query("WITH " + PLAYER + """, p AS (SELECT *, CASE WHEN match_id % 4 = 1 AND player % 7 > 0 THEN ['Sturm', 'Mittelfeld', 'Abwehr'][player % 3 + 1] END AS position FROM player),
f AS (SELECT match_id, player, coalesce(position, first_value(position IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(position IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS position
  FROM p WINDOW w AS (PARTITION BY season, player ORDER BY kick_off, match_id))
SELECT match_id, player, CASE WHEN position = 'Sturm' THEN 1 ELSE 0 END AS position_forward, CASE WHEN position IS NULL THEN 1 ELSE 0 END AS position_unknown FROM f""")
def position_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dummy for forwards and one for unknown positions, filled within season and player only."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    name = F.element_at(F.array(*map(F.lit, ("Sturm", "Mittelfeld", "Abwehr"))), (F.col("player") % 3 + 1).cast("int"))
    rows = rows.withColumn("position", F.when((F.col("match_id") % 4 == 1) & (F.col("player") % 7 > 0), name))
    group = ["season", "player"]
    filled = rows.select("match_id", "player", features.filled("position", group, group, ["kick_off", "match_id"]).alias("position"))
    return features.position_dummies(filled, "position", "Sturm").select("match_id", "player", "position_forward", "position_unknown")


@query("WITH " + T.SCORERS + """ SELECT match_id, player, round(avg(CASE WHEN minute < 45 THEN 45 - minute ELSE 90 - minute END), 6) AS minutes_left, count(*) AS goals FROM scorers GROUP BY match_id, player""")
def goal_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean minutes from a player's goals to the end of the half they fell in."""
    return features.minutes_to_whistle(T.scorers(spark, sf_dir)).withColumn("minutes_left", F.round("minutes_left", 6))


@query("WITH " + PRIOR + """, d AS (SELECT gameday, avg(points_team) AS pm, stddev_samp(points_team) AS ps, avg(gf_team) AS gm, stddev_samp(gf_team) AS gs FROM pre WHERE season < 2000 GROUP BY gameday)
SELECT round(avg(pm), 6) AS points_team_mean, round(avg(ps), 6) AS points_team_sd, round(avg(gm), 6) AS gf_team_mean, round(avg(gs), 6) AS gf_team_sd FROM d""")
def frozen_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mean and deviation for each feature: the mean over match days of the days' moments."""
    pre = features.pre_match(T.sides(T.games(spark, sf_dir))).where("season < 2000")
    out = Z.frozen_scalars(Z.moments(pre, ["points_team", "gf_team"], ["gameday"]), ["points_team", "gf_team"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("WITH RECURSIVE " + T.GAMES + ", " + elo_sql("f") + """, s AS (SELECT league, season, kick_off, match_id, home AS team, home_elo AS elo FROM f WHERE i > 0 UNION ALL SELECT league, season, kick_off, match_id, away, away_elo FROM f WHERE i > 0)
SELECT league, season, team, round(arg_min(elo, struct_pack(d := kick_off, m := match_id)), 4) AS elo FROM s GROUP BY league, season, team""")
def season_start_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's rating at its first match of a season."""
    games = T.games(spark, sf_dir)
    rated = ratings.elo(games).join(games.select("match_id", "kick_off", "home", "away"), "match_id")
    side = lambda t: F.struct(F.col(t).alias("team"), F.col(f"{t}_elo").alias("elo"))
    rows = rated.select("league", "season", "kick_off", "match_id", F.explode(F.array(side("home"), side("away"))).alias("s"))
    first = F.min_by("s.elo", F.struct("kick_off", "match_id"))
    return rows.groupBy("league", "season", F.col("s.team").alias("team")).agg(F.round(first, 4).alias("elo"))


@query("WITH " + T.GAMES + """, r AS (SELECT season, match_id, hg, CASE WHEN match_id % 3 > 0 THEN ag END AS factor FROM games)
SELECT season, count(*) FILTER (hg IS NOT NULL AND factor IS NOT NULL) AS complete, count(*) FILTER (hg IS NOT NULL) AS with_target FROM r GROUP BY season""")
def null_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows that stay if any null drops a row, and if only those in the target and the ids do."""
    rows = T.games(spark, sf_dir).select("season", "match_id", "hg", F.when(F.col("match_id") % 3 > 0, F.col("ag")).alias("factor"))
    count = lambda kept, name: kept.groupBy("season").agg(F.count("*").alias(name))
    both = rows.select("season").distinct().join(count(rows.dropna(), "complete"), "season", "left").join(count(rows.dropna(subset=["season", "match_id", "hg"]), "with_target"), "season", "left")
    return both.fillna(0, ["complete", "with_target"])


@query("WITH " + T.FORECASTS + """, e AS (SELECT k, p[k + 1] AS x, CASE WHEN y = k THEN 1.0::DOUBLE ELSE 0 END AS hit FROM forecasts CROSS JOIN range(0, 3) r(k))
SELECT CAST(k AS INTEGER) AS class, CAST(floor(x * 10) AS INTEGER) AS bin, count(*) AS count, round(avg(hit), 6) AS observed, round(avg(x), 6) AS predicted FROM e WHERE floor(x * 10) < 10 GROUP BY 1, 2 HAVING count(*) >= 8""")
def reliability_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every class in bins of at least eight forecasts."""
    r = E.reliability_curves(T.forecasts(spark, sf_dir), 3, 10, 8)
    return r.select("class", "bin", "count", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"))


@query("WITH " + T.FORECASTS + """, t AS (SELECT *, list_transform(p, lambda x: pow(x, 1 / 1.3::DOUBLE)) AS q FROM forecasts), c AS (SELECT fold, y, p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM t),
d AS (SELECT fold, -ln(greatest(q[y + 1], 1e-12)) + ln(greatest(p[y + 1], 1e-12)) AS a, """ + " - ".join(f"(pow({v}[1] - CASE WHEN y < 1 THEN 1 ELSE 0 END, 2) + pow({v}[1] + {v}[2] - CASE WHEN y < 2 THEN 1 ELSE 0 END, 2)) / 2" for v in "qp") + """ AS b FROM c),
s AS (SELECT fold, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(a) / (stddev_samp(a) / sqrt(count(*))) AS ta, avg(b) / (stddev_samp(b) / sqrt(count(*))) AS tb FROM d GROUP BY fold)
SELECT fold, n, round(a, 6) AS log_loss, round(b, 6) AS rps, round(ta, 4) AS log_loss_t, round(tb, 4) AS rps_t, a < 0 AND b < 0 AND abs(ta) >= 2.5 AND abs(tb) >= 2.5 AS qualifies FROM s""")
def adoption_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tempered forecasts replace the plain ones: better in both metrics and by |t| of 2.5 at least."""
    p, q, y = F.col("p"), F.col("q"), F.col("y")
    rows = T.forecasts(spark, sf_dir).withColumn("q", S.tempered(p, 1.3))
    rows = rows.select("fold", (S.log_score(p, y) - S.log_score(q, y)).alias("log_loss"), (S.ranked_probability(q, y) - S.ranked_probability(p, y)).alias("rps"))
    out = E.adoption(rows, ["log_loss", "rps"], "fold")
    return out.select("fold", "n", F.round("log_loss", 6).alias("log_loss"), F.round("rps", 6).alias("rps"), F.round("log_loss_t", 4).alias("log_loss_t"), F.round("rps_t", 4).alias("rps_t"), "qualifies")


@query("WITH " + T.FORECASTS + """, b AS (SELECT fold, CASE WHEN y = 2 THEN 1 ELSE 0 END AS y, p[3] AS p FROM forecasts)
SELECT fold, round(avg(-((1 - y) * ln(greatest(1 - p, 1e-5)) + y * ln(greatest(p, 1e-5)))), 6) AS log_loss, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse FROM b GROUP BY fold""")
def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss with clipped probabilities and root mean square error of a yes-or-no forecast."""
    rows = T.forecasts(spark, sf_dir).select("fold", (F.col("y") == 2).cast("int").alias("y"), F.col("p")[2].alias("p"))
    return rows.groupBy("fold").agg(F.round(F.avg(E.binary_log_loss(F.col("y"), F.col("p"))), 6).alias("log_loss"), F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))), 6).alias("rmse"))


@query("WITH " + T.FORECASTS + """, h AS (SELECT y, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 0 WHEN p[2] >= p[3] THEN 1 ELSE 2 END AS b FROM forecasts), s AS (SELECT """
  + ", ".join(f"avg(CASE WHEN y = {k} AND b = {k} THEN 1.0::DOUBLE ELSE 0 END) AS c{k}" for k in range(3)) + """ FROM h)
SELECT round(c0, 6) AS class_0, round(c1, 6) AS class_1, round(c2, 6) AS class_2, round(c0 + c1 + c2, 6) AS all, round(c1 + c2, 6) AS above_0 FROM s""".replace(" AS all,", ' AS "all",'))
def joint_class_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows whose class came and was predicted, by class, in all, and without the first class."""
    out = E.joint_hits(T.forecasts(spark, sf_dir).select("y", S.predicted(F.col("p")).alias("y_hat")), 3)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("WITH " + REPS + """, t AS (SELECT h + a AS n FROM reps) SELECT round(avg(n), 6) AS mean, max(n) AS most, """ + ", ".join(f"round(avg(CASE WHEN n > {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_{k}" for k in (6, 10, 15, 30))
  + """, avg(CASE WHEN n > 15 THEN 1.0::DOUBLE ELSE 0 END) < 0.01 AND avg(CASE WHEN n > 30 THEN 1.0::DOUBLE ELSE 0 END) < 0.0001 AS plausible, """
  + ", ".join(f"round(quantile_cont(n::DOUBLE, {q}), 6) AS {name}" for q, name in ((0.5, "median"), (0.9, "q90"), (0.99, "q99"), (0.999, "q999"))) + " FROM t")
def prior_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated goals of a match: quantiles, exceedances, and whether those are below their limits."""
    drawn = replicated(spark, sf_dir)[1].select((F.col("h") + F.col("a")).alias("n"))
    out = E.plausible(drawn, "n", {6: None, 10: None, 15: 0.01, 30: 1e-4})
    return out.select(*[c if c in ("most", "plausible") else F.round(c, 6).alias(c) for c in out.columns])


AUDITED = PLAYER + """, t AS (SELECT *, CAST(coalesce(sum(goals) OVER w, 0) AS BIGINT) AS before, row_number() OVER (PARTITION BY league, season, player ORDER BY kick_off, match_id) AS n,
  CAST(coalesce(sum(goals) OVER (PARTITION BY league, season, team ORDER BY kick_off, match_id, player ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS team_before
  FROM player WINDOW w AS (PARTITION BY league, season, player ORDER BY kick_off, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, before - lag(before) OVER w AS d, lag(goals) OVER w AS prev, CASE WHEN team_before > 0 THEN before / team_before::DOUBLE END AS share, min(gameday) OVER (PARTITION BY league, season, team) AS opening FROM t WINDOW w AS (PARTITION BY league, season, player ORDER BY kick_off, match_id))"""


@query("WITH " + AUDITED + ", " + PRIOR.removeprefix(T.GAMES + ", ").replace("sides AS (", "sides AS (", 1) + """, f AS (SELECT avg(CASE WHEN points_team = 0 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM (SELECT *, min(gameday) OVER (PARTITION BY league, season, team) AS opening FROM pre) WHERE gameday = opening),
m AS (SELECT avg(CASE WHEN d = prev THEN 1.0::DOUBLE ELSE 0 END) FILTER (n > 1) AS pre, avg(CASE WHEN d = goals THEN 1.0::DOUBLE ELSE 0 END) FILTER (n > 1) AS post, avg(CASE WHEN before = 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (n = 1) AS first,
  avg(CASE WHEN abs(share - round(share, 9)) <= 1e-8 + 1e-5 * abs(round(share, 9)) THEN 1.0::DOUBLE ELSE 0 END) FILTER (share IS NOT NULL) AS same, count(*) FILTER (share > 1) AS over, max(goals) AS top, avg(CASE WHEN goals > 6 THEN 1.0::DOUBLE ELSE 0 END) AS above FROM a),
d AS (SELECT season, count(*) / count(DISTINCT match_id)::DOUBLE AS x FROM player GROUP BY season), o AS (SELECT count(*) AS n FROM d, (SELECT median(x) AS med FROM d) WHERE abs(x - med) / med > 0.25)
SELECT 'timing: total is that before the match' AS "check", CASE WHEN pre > 0.995 AND pre > post THEN 'PASS' ELSE 'FAIL' END AS result, concat(printf('%.4f', pre), ' against ', printf('%.4f', post)) AS detail FROM m
UNION ALL SELECT 'timing: first appearance has 0', CASE WHEN first = 1 THEN 'PASS' ELSE 'FAIL' END, printf('%.4f', first) FROM m UNION ALL SELECT 'timing: points are 0 at the first match', CASE WHEN v = 1 THEN 'PASS' ELSE 'FAIL' END, printf('%.4f', v) FROM f
UNION ALL SELECT 'timing: share is the ratio', CASE WHEN same > 0.999 THEN 'PASS' ELSE 'FAIL' END, printf('%.4f', same) FROM m UNION ALL SELECT 'sanity: shares above 1', CASE WHEN over < 50 THEN 'PASS' ELSE 'WARN' END, CAST(over AS VARCHAR) FROM m
UNION ALL SELECT 'sanity: goal counts', CASE WHEN top <= 6 OR above < 0.001 THEN 'PASS' ELSE 'WARN' END, CAST(top AS VARCHAR) FROM m UNION ALL SELECT 'appearance density', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(n AS VARCHAR) FROM o""")
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the totals, points and shares of a table of appearances have to satisfy, and how dense appearances are."""
    games = T.games(spark, sf_dir)
    rows = features.player_goals(games, T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    part, order = [*L.KEYS, "player"], ["kick_off", "match_id"]
    rows = rows.withColumns({"before": features.running_before("goals", part, order), "team_before": features.running_before("goals", [*L.KEYS, "team"], [*order, "player"])})
    stored = rows.withColumn("share", F.when(F.col("team_before") > 0, F.round(F.col("before") / F.col("team_before"), 9)))
    pre = features.pre_match(T.sides(games))
    return A.audit([A.timing(A.with_lags(stored, "before", "goals", part, order), "before", "team_before", "share", "goals"), A.opening(pre, "points_team", [*L.KEYS, "team"], "gameday"), A.density(rows, "season", "match_id", 0.25)])


@query("WITH " + PLAYER + """ SELECT 'league' AS by, league AS value, round(avg(goals), 6) AS goals, count(*) AS n FROM player GROUP BY league UNION ALL SELECT 'season', CAST(season AS VARCHAR), round(avg(goals), 6), count(*) FROM player GROUP BY season""".replace("AS by", 'AS "by"'))
def drift_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals an appearance by league and by season."""
    return A.drift(features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir)), "goals", ["league", "season"]).withColumn("goals", F.round("goals", 6))


@query("WITH " + PLAYER + """, u AS (SELECT gameday, match_id, max(substitute_in) AS any FROM player GROUP BY gameday, match_id) SELECT gameday, count(*) AS units, round(avg("any"), 6) AS rate FROM u GROUP BY gameday""".replace("AS any FROM", 'AS "any" FROM'))
def assignment_by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of matches with any substitution by match day, each match counted once."""
    rows = T.lineup(spark, sf_dir).join(T.games(spark, sf_dir).select("match_id", "gameday"), "match_id").select("gameday", "match_id", F.col("substitute_in").alias("treated"))
    return causal.assignment_rates(rows, "gameday", "match_id").withColumn("rate", F.round("rate", 6))
