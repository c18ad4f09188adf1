"""Ladder, as-of features, player totals, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import scalars
from touchline.operators import features, segments
from touchline.operators import ladder as L
from touchline.plans.registry import query
from touchline.sources import tables as T

LADDER = T.SIDES + """, teams AS (SELECT DISTINCT league, season, team FROM sides WHERE home_pitch = 1),
days AS (SELECT DISTINCT league, season, gameday FROM sides),
per_day AS (
  SELECT league, season, gameday, team, count(gf) AS played_n, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn,
    count(*) FILTER (gf < ga) AS lost, coalesce(sum(gf), 0) AS gf, coalesce(sum(ga), 0) AS ga,
    coalesce(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 WHEN gf < ga THEN 0 END), 0) AS points
  FROM sides GROUP BY ALL),
ladder AS (
  SELECT league, season, gameday, team,
    CAST(sum(coalesce(played_n, 0)) OVER w AS BIGINT) AS played_n, CAST(sum(coalesce(won, 0)) OVER w AS BIGINT) AS won,
    CAST(sum(coalesce(drawn, 0)) OVER w AS BIGINT) AS drawn, CAST(sum(coalesce(lost, 0)) OVER w AS BIGINT) AS lost,
    CAST(sum(coalesce(gf, 0)) OVER w AS BIGINT) AS gf, CAST(sum(coalesce(ga, 0)) OVER w AS BIGINT) AS ga,
    CAST(sum(coalesce(points, 0)) OVER w AS BIGINT) AS points,
    CAST(sum(coalesce(gf, 0)) OVER w AS BIGINT) - CAST(sum(coalesce(ga, 0)) OVER w AS BIGINT) AS balance
  FROM teams JOIN days USING (league, season) LEFT JOIN per_day USING (league, season, gameday, team)
  WINDOW w AS (PARTITION BY league, season, team ORDER BY gameday ROWS UNBOUNDED PRECEDING))"""


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ladder(T.sides(T.games(spark, sf_dir)))


@query("WITH " + LADDER + " SELECT * FROM ladder")
def ladder_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2: standings after every match day."""
    return _ladder(spark, sf_dir)


@query("WITH " + LADDER + """ SELECT league, season, team, points, balance, gf, ga, won, drawn, lost, played_n,
  CAST(row_number() OVER (PARTITION BY league, season, gameday ORDER BY points DESC, balance DESC, gf DESC, team) AS INTEGER) AS place
  FROM ladder QUALIFY gameday = max(gameday) OVER (PARTITION BY league, season)""")
def ladder_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 at the latest match day, sorted by points, balance, goals (O1)."""
    last = F.max("gameday").over(Window.partitionBy(*L.KEYS))
    table = _ladder(spark, sf_dir).withColumn("last", last).where("gameday = last")
    place = F.row_number().over(Window.partitionBy(*L.KEYS).orderBy(F.desc("points"), F.desc("balance"), F.desc("gf"), "team"))
    return table.select(*L.KEYS, "team", "points", "balance", "gf", "ga", "won", "drawn", "lost", "played_n", place.alias("place"))


@query("WITH " + LADDER + """, r AS (SELECT league, season, gameday, team,
  count(*) OVER (PARTITION BY league, season, gameday) - (rank() OVER (PARTITION BY league, season, gameday ORDER BY gf)
    + (count(*) OVER (PARTITION BY league, season, gameday, gf) - 1) / 2.0::DOUBLE) AS scored_rank,
  rank() OVER (PARTITION BY league, season, gameday ORDER BY ga)
    + (count(*) OVER (PARTITION BY league, season, gameday, ga) - 1) / 2.0::DOUBLE AS conceded_rank FROM ladder)
SELECT *, CAST(floor(scored_rank) AS INTEGER) AS scored_rank_int, CAST(floor(conceded_rank) AS INTEGER) AS conceded_rank_int FROM r""")
def ladder_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-tie ranks and their whole parts."""
    return L.ranked(_ladder(spark, sf_dir)).select(
        *L.KEYS, "gameday", "team", "scored_rank", "conceded_rank", "scored_rank_int", "conceded_rank_int"
    )


PRIOR = LADDER + """, prior AS (
  SELECT league, season, gameday, lag(gameday) OVER (PARTITION BY league, season ORDER BY gameday) AS prior FROM (SELECT DISTINCT league, season, gameday FROM ladder)),
pre AS (
  SELECT s.*, coalesce(a.points, 0) AS points_team, coalesce(a.gf, 0) AS gf_team, coalesce(a.ga, 0) AS ga_team,
    coalesce(b.points, 0) AS points_opp, coalesce(b.gf, 0) AS gf_opp, coalesce(b.ga, 0) AS ga_opp
  FROM sides s LEFT JOIN prior p USING (league, season, gameday)
  LEFT JOIN ladder a ON a.league = s.league AND a.season = s.season AND a.gameday = p.prior AND a.team = s.team
  LEFT JOIN ladder b ON b.league = s.league AND b.season = s.season AND b.gameday = p.prior AND b.team = s.opp)"""


@query("WITH " + PRIOR + """ SELECT match_id, home_pitch, team, opp, points_team, points_opp, gf_team - gf_opp AS goalsscored_diff,
  gf_team - ga_team AS goal_balance_team, gf_opp - ga_opp AS goal_balance_opp, (gf_team - ga_team) - (gf_opp - ga_opp) AS goal_balance_diff,
  points_team - points_opp AS points_diff, gf_team * gf_opp AS momentum_product, gf_team + ga_opp AS offence_against_defence FROM pre""")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings before the match on both sides and their differences."""
    return features.differences(features.pre_match(T.sides(T.games(spark, sf_dir)))).select(
        "match_id", "home_pitch", "team", "opp", "points_team", "points_opp", "goalsscored_diff", "goal_balance_team",
        "goal_balance_opp", "goal_balance_diff", "points_diff", "momentum_product", "offence_against_defence",
    )


@query("WITH " + LADDER + """, last AS (SELECT * FROM ladder QUALIFY gameday = max(gameday) OVER (PARTITION BY league, season))
SELECT g.match_id, h.points AS points_team, a.points AS points_opp FROM games g JOIN last h ON h.league = g.league AND h.season = g.season AND h.team = g.home
JOIN last a ON a.league = g.league AND a.season = g.season AND a.team = g.away WHERE NOT g.played""")
def fixtures_latest_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot for matches that are not played yet."""
    games = T.games(spark, sf_dir)
    latest = _ladder(spark, sf_dir).groupBy(*L.KEYS, "team").agg(F.max_by("points", "gameday").alias("points"))
    home = latest.select(*L.KEYS, F.col("team").alias("home"), F.col("points").alias("points_team"))
    away = latest.select(*L.KEYS, F.col("team").alias("away"), F.col("points").alias("points_opp"))
    return games.where(~F.col("played")).join(home, [*L.KEYS, "home"]).join(away, [*L.KEYS, "away"]).select("match_id", "points_team", "points_opp")


PLAYER = T.GAMES + ", " + T.LINEUP + ", " + T.SCORERS + """, goals AS (
  SELECT match_id, player, count(*) AS goals, count(*) FILTER (minute < 45) AS first_half, count(*) FILTER (minute >= 45) AS second_half,
    avg(90 - minute) AS minutes_left FROM scorers GROUP BY ALL),
player AS (
  SELECT l.match_id, l.player, l.home_pitch, l.substitute_in, g.league, g.season, g.gameday, g.kick_off, CASE WHEN l.home_pitch = 1 THEN g.home ELSE g.away END AS team,
    coalesce(x.goals, 0) AS goals, coalesce(x.first_half, 0) AS first_half, coalesce(x.second_half, 0) AS second_half, x.minutes_left
  FROM lineup l JOIN games g USING (match_id) LEFT JOIN goals x ON x.match_id = l.match_id AND x.player = l.player)"""


@query("WITH " + PLAYER + " SELECT match_id, player, team, goals, first_half, second_half, round(minutes_left, 6) AS minutes_left, least(goals, 3) AS goals_capped FROM player")
def player_match_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals by player and match, split at minute 45."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    return rows.select(
        "match_id", "player", "team", "goals", "first_half", "second_half", F.round("minutes_left", 6).alias("minutes_left"),
        F.least("goals", F.lit(3).cast("long")).alias("goals_capped"),
    )


@query("WITH " + PLAYER + """, run AS (SELECT match_id, player, goals, CAST(coalesce(sum(goals) OVER w, 0) AS BIGINT) AS before,
  CAST(sum(goals) OVER (PARTITION BY league, season, team ORDER BY kick_off, match_id, player ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS team_before
  FROM player WINDOW w AS (PARTITION BY league, season, player ORDER BY kick_off, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, player, goals, before, coalesce(team_before, 0) AS team_before, round(CASE WHEN coalesce(team_before, 0) = 0 THEN 0 ELSE before / team_before::DOUBLE END, 6) AS share FROM run""")
def player_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals before the match and the guarded share of the team's."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    before = features.running_before("goals", ["league", "season", "player"], ["kick_off", "match_id"])
    team = features.running_before("goals", ["league", "season", "team"], ["kick_off", "match_id", "player"])
    out = rows.select("match_id", "player", "goals", before.alias("before"), team.alias("team_before"))
    return out.withColumn("share", F.round(scalars.guarded_ratio(F.col("before"), F.col("team_before")), 6))


@query("WITH " + LADDER + ", " + T.LINEUP + ", " + T.SCORERS + """, own AS (
  SELECT g.league, g.season, g.gameday, CASE WHEN l.home_pitch = 1 THEN g.home ELSE g.away END AS team, s.player, count(*) AS own
  FROM scorers s JOIN lineup l ON l.match_id = s.match_id AND l.player = s.player JOIN games g ON g.match_id = s.match_id GROUP BY ALL)
SELECT o.league, o.season, o.gameday, o.team, o.player, l.gf - o.own AS gf_without,
  count(*) - ((count(*) FILTER (x.team <> l.team AND x.gf < l.gf - o.own)) + ((count(*) FILTER (x.team <> l.team AND x.gf = l.gf - o.own)) + 2) / 2.0::DOUBLE) AS rank_without
FROM own o JOIN ladder l USING (league, season, gameday, team) JOIN ladder x ON x.league = l.league AND x.season = l.season AND x.gameday = l.gameday
GROUP BY o.league, o.season, o.gameday, o.team, o.player, l.gf, o.own""")
def rank_without_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team's scored-rank if the player's goals of the day are taken from it; against an array of at most a league's teams."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    own = rows.where("goals > 0").groupBy(*L.KEYS, "gameday", "team", "player").agg(F.sum("goals").alias("own"))
    table = _ladder(spark, sf_dir)
    snap = table.groupBy(*L.KEYS, "gameday").agg(F.collect_list("gf").alias("all"))
    both = own.join(table.select(*L.KEYS, "gameday", "team", "gf"), [*L.KEYS, "gameday", "team"]).join(snap, [*L.KEYS, "gameday"])
    without = F.col("gf") - F.col("own")
    return both.select(*L.KEYS, "gameday", "team", "player", without.alias("gf_without"), L.rank_without(without, F.col("all"), F.col("gf")).alias("rank_without"))


FORM = PRIOR + """, form AS (SELECT *, row_number() OVER (PARTITION BY league, season, team ORDER BY kick_off, match_id, home_pitch) AS i FROM pre)"""


def ewma_sql(value: str, half: float) -> str:
    """The adjusted mean up to each row as two running sums of weights that grow with the row's number i."""
    w = f"pow(2.0::DOUBLE, i / {half}::DOUBLE)"
    return f"sum({value} * {w}) OVER form_rows / sum({w}) OVER form_rows"


FORM_ROWS = "form_rows AS (PARTITION BY league, season, team ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("WITH " + FORM + ", f AS (SELECT *, " + ewma_sql("points_team::DOUBLE", 4.0) + " AS ewma FROM form WINDOW " + FORM_ROWS + """),
g AS (SELECT *, ewma - lag(ewma) OVER (PARTITION BY league, season, team ORDER BY i) AS d FROM f)
SELECT x.match_id, x.home_pitch, round(x.ewma, 6) AS ewma, round(coalesce(x.d, x.ewma), 6) AS ewma_diff, round(y.ewma, 6) AS ewma_opp
FROM g x JOIN g y ON x.match_id = y.match_id AND x.opp = y.team""")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted EWMA (half-life 4) of pre-match points by team and season, its difference, and the opponent's."""
    pre = features.pre_match(T.sides(T.games(spark, sf_dir)))
    key, order = ["league", "season", "team"], ["kick_off", "match_id", "home_pitch"]
    form = features.ewma(pre, "points_team", key, order, 4.0, "ewma")
    d = F.col("ewma") - F.lag("ewma").over(Window.partitionBy(*key).orderBy(*order))
    form = form.select("match_id", "home_pitch", "ewma", F.coalesce(d, "ewma").alias("d"))
    return features.of_opponent(form, {"ewma": "ewma_opp"}).select(
        "match_id", "home_pitch", F.round("ewma", 6).alias("ewma"), F.round("d", 6).alias("ewma_diff"), F.round("ewma_opp", 6).alias("ewma_opp")
    )


@query("WITH " + PLAYER + """, p AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN team END AS position FROM player)
SELECT match_id, player,
  coalesce(position, first_value(position IGNORE NULLS) OVER (PARTITION BY season, player ORDER BY kick_off, match_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(position IGNORE NULLS) OVER (PARTITION BY player ORDER BY kick_off, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS position,
  CAST(dense_rank() OVER (PARTITION BY player ORDER BY season) - 1 AS INTEGER) AS season_number,
  CAST(kick_off - min(kick_off) OVER (PARTITION BY season, player) AS INTEGER) AS days_since_first,
  row_number() OVER (PARTITION BY season, player ORDER BY kick_off, match_id) = 1 AS first_row,
  round(avg(goals) OVER (PARTITION BY player), 6) AS player_mean FROM p""")
def player_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill backward then forward, season numbers, days since the first game, first rows, a player's mean."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    rows = rows.withColumn("position", F.when(F.col("match_id") % 3 == 0, F.col("team")))
    order = ["kick_off", "match_id"]  # a season is a year of kick_off: with it in front the order is the same, and one sort serves all windows
    season, player = Window.partitionBy("player", "season"), Window.partitionBy("player")
    rows = rows.select("match_id", "player", "season", "kick_off", "position", "goals").repartition("player").sortWithinPartitions("player", "season", *order)
    return rows.select(
        "match_id", "player",
        features.filled("position", ["player", "season"], ["player"], order, ["season", *order]).alias("position"),
        (F.dense_rank().over(player.orderBy("season")) - 1).cast("int").alias("season_number"),
        F.datediff("kick_off", F.min("kick_off").over(season)).alias("days_since_first"),
        (F.row_number().over(season.orderBy(*order)) == 1).alias("first_row"),
        F.round(F.avg("goals").over(player), 6).alias("player_mean"),
    )


@query("WITH " + T.MATCH_EVENTS + """, subs AS (SELECT DISTINCT match_id, side, minute AS t FROM match_events WHERE event_type = 'error'),
ends AS (SELECT match_id, max(minute) AS last FROM match_events GROUP BY 1),
seg AS (SELECT s.*, coalesce(lag(t) OVER w, -1) AS p, coalesce(lead(t) OVER w, last) AS n FROM subs s JOIN ends USING (match_id) WINDOW w AS (PARTITION BY match_id, side ORDER BY t))
SELECT s.match_id, s.side, s.t AS minute,
  count(*) FILTER (e.minute > s.p AND e.minute < s.t AND e.event_type = 'click' AND e.side = s.side) AS click_off_pre,
  count(*) FILTER (e.minute > s.t AND e.minute < s.n AND e.event_type = 'click' AND e.side = s.side) AS click_off_post,
  count(*) FILTER (e.minute > s.p AND e.minute < s.t AND e.event_type = 'click' AND e.side <> s.side) AS click_def_pre,
  count(*) FILTER (e.minute > s.t AND e.minute < s.n AND e.event_type = 'click' AND e.side <> s.side) AS click_def_post,
  round(coalesce(sum(e.value) FILTER (e.minute > s.p AND e.minute < s.t), 0), 4) AS value_pre,
  round(coalesce(sum(e.value) FILTER (e.minute > s.t AND e.minute < s.n), 0), 4) AS value_post
FROM seg s JOIN match_events e ON e.match_id = s.match_id GROUP BY s.match_id, s.side, s.t""")
def substitution_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after each substitution minute, strict on both sides."""
    return features.segments(T.match_events(spark, sf_dir), "error", ["click"])


#: The measures of an event in SQL, by name.
MEASURES = {
    "clearances_total": "count(clearance_body_part)", "dribble_total": "count(dribble_outcome)", "dribble_success": "count(*) FILTER (dribble_outcome = 'Complete')",
    "duel_total": "count(duel_outcome)", "duel_success": "count(*) FILTER (duel_outcome IN ('Won', 'Success', 'Success in Play', 'Success Out'))", "fouls_committed": "count(foul_committed_type)",
    "interceptions_total": "count(interception_outcome)", "interceptions_success": "count(*) FILTER (interception_outcome IN ('Won', 'Success', 'Success in Play', 'Success Out'))",
    "pass_shot_assist": "count(pass_shot_assist)", "pass_goal_assist": "count(pass_goal_assist)",
    **{f"pass_success_length__{k}": f"coalesce(sum(pass_length / 0.9144::DOUBLE) FILTER (pass_outcome IS NULL AND {w}), 0)" for k, w in {
        "total": "true", "0_5": "pass_length <= 5 / 0.9144::DOUBLE", "5_10": "pass_length > 5 / 0.9144::DOUBLE AND pass_length <= 10 / 0.9144::DOUBLE",
        "10_20": "pass_length > 10 / 0.9144::DOUBLE AND pass_length <= 20 / 0.9144::DOUBLE", "20_40": "pass_length > 20 / 0.9144::DOUBLE AND pass_length <= 40 / 0.9144::DOUBLE",
        "40": "pass_length > 40 / 0.9144::DOUBLE"}.items()},
    "passes_total": "count(pass_length)", "passes_success": "count(pass_length) FILTER (pass_outcome IS NULL)", "shots_total": "count(shot_outcome)",
    "shots_target": "count(shot_outcome) FILTER (shot_outcome NOT IN ('Off T', 'Wayward'))", "goals_scored": "count(*) FILTER (shot_outcome = 'Goal')",
    "substitution_tactical": "count(*) FILTER (substitution_outcome = 'Tactical')",
}


def _in(measure: str, where: str) -> str:
    """A measure's aggregate with one more condition."""
    return measure.replace("FILTER (", f"FILTER ({where} AND ") if "FILTER" in measure else f"{measure} FILTER ({where})"


SUBSTITUTIONS = "WITH " + T.MATCH_DETAILS + """, m AS (SELECT match_id, count(*) FILTER (shot_outcome = 'Goal' AND side = 0 AND minute < 60) AS g0, count(*) FILTER (shot_outcome = 'Goal' AND side = 1 AND minute < 60) AS g1, max(minute) AS last FROM match_details GROUP BY 1),
o AS (SELECT match_id, last, CASE WHEN g0 < g1 THEN 0 ELSE 1 END AS off, least(g0, g1) AS score60_off, greatest(g0, g1) AS score60_def FROM m WHERE g0 <> g1),
s AS (SELECT DISTINCT o.match_id, e.minute AS t FROM o JOIN match_details e ON e.match_id = o.match_id AND e.side = o.off AND e.substitution_outcome = 'Tactical' AND e.minute > 59),
b AS (SELECT s.match_id, t FROM s JOIN o USING (match_id) WHERE t < last UNION ALL SELECT match_id, 59 FROM o WHERE match_id NOT IN (SELECT match_id FROM s)),
w AS (SELECT o.*, b.t, coalesce(lead(b.t) OVER (PARTITION BY b.match_id ORDER BY b.t), o.last) AS n FROM b JOIN o USING (match_id)),
x AS (SELECT w.match_id, w.t AS substitution_minute, any_value(w.n - w.t) AS minutes_after, any_value(w.off) AS off, any_value(w.score60_off) AS score60_off, any_value(w.score60_def) AS score60_def, """ + ", ".join(
    _in(m, f"e.side {'=' if role == 'off' else '<>'} w.off AND " + ("e.minute < w.t" if part == "pre" or n == "duel_total" else "e.minute > w.t AND e.minute < w.n")) + f" AS {n}__{role}__{part}"
    for n, m in MEASURES.items() for role in ("off", "def") for part in ("pre", "post")
) + " FROM w JOIN match_details e ON e.match_id = w.match_id GROUP BY w.match_id, w.t)"


@query(SUBSTITUTIONS + " SELECT match_id, substitution_minute, minutes_after, off, score60_off, score60_def, " + ", ".join(
    f"round(CAST({n}__{r}__{p} AS DOUBLE), 4) AS {n}__{r}__{p}" for n in MEASURES for r in ("off", "def") for p in ("pre", "post")) + " FROM x")
def substitution_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of both sides before and after each tactical substitution of the trailing side, by prefix sums."""
    rows = segments.around_substitutions(T.match_details(spark, sf_dir))
    kept = ("match_id", "substitution_minute", "minutes_after", "off", "score60_off", "score60_def")
    return rows.select(*kept, *[F.round(c, 4).alias(c) for c in rows.columns if c not in kept])


def _rate(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / nullif({d}, 0)"


def _strength(role: str, part: str) -> str:
    at = lambda n: f"{n}__{role}__{part}"
    passes = _rate("(" + " + ".join(at(f"pass_success_length__{k}") for k in ("0_5", "5_10", "10_20", "20_40", "40")) + ")", at("pass_success_length__total"))
    return " + ".join(f"0.2::DOUBLE * ({r})" for r in (passes, *[_rate(at(a), at(b)) for a, b in segments.SKILLS.items()]))


@query(SUBSTITUTIONS + ", y AS (SELECT *, " + ", ".join(
    f"{_rate(f'{t}__{r}__{p}', 'substitution_minute' if p == 'pre' else 'minutes_after')} AS {n}_perMin__{r}__{p}" for n, t in segments.RATES.items() for r in ("off", "def") for p in ("pre", "post")
) + ", " + ", ".join(f"{_strength(r, p)} AS strength__{r}__{p}" for r in ("off", "def") for p in ("pre", "post")) + " FROM x) SELECT match_id, substitution_minute, " + ", ".join(
    [f"round({n}_perMin__{r}__{p}, 6) AS {n}_perMin__{r}__{p}" for n in segments.RATES for r in ("off", "def") for p in ("pre", "post")]
    + [f"round({n}_perMin__off__post - {n}_perMin__off__pre, 6) AS {n}_perMin__off__DIFF, round(CAST({t}__off__pre - {t}__def__pre AS DOUBLE), 4) AS strength_diff__{n}" for n, t in segments.RATES.items()]
    + [f"round(strength__{r}__{p}, 6) AS strength__{r}__{p}" for r in ("off", "def") for p in ("pre", "post")] + [f"round(strength__off__{p} - strength__def__{p}, 6) AS strength_diff__{p}" for p in ("pre", "post")]) + " FROM y")
def substitution_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates a minute, their changes, and composite strengths of both sides before and after."""
    rows = segments.strengths(segments.per_minute(segments.around_substitutions(T.match_details(spark, sf_dir))))
    out = [c for c in rows.columns if "_perMin__" in c or c.startswith("strength")]
    return rows.select("match_id", "substitution_minute", *[F.round(c, 6).alias(c) for c in out])
