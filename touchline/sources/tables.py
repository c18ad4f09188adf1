"""Logical tables of a competition, bound to the star-schema tables that are at hand, and their DuckDB twins.

The binding is arithmetic on keys, so both engines see equal rows: an order is a match, a line item an appearance (and a goal
event if its quantity is large), an event row a minute-stamped event, a part a bookmaker's odds, an embedding 64 posterior draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, league, season, kick_off, gameday, home, away, hg, ag (null until played), played."""
    o = table(spark, sf_dir, "orders")
    played = F.col("o_orderstatus") != "P"
    home = F.col("o_custkey") % TEAMS
    return o.select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderpriority").alias("league"),
        F.year("o_orderdate").alias("season"),
        F.to_date("o_orderdate").alias("kick_off"),
        F.floor(1 + (F.dayofyear("o_orderdate") - 1) / 10).cast("int").alias("gameday"),
        home.alias("home"),
        ((home + 1 + F.col("o_orderkey") % (TEAMS - 1)) % TEAMS).alias("away"),
        F.when(played, F.floor("o_totalprice").cast("long") % 5).alias("hg"),
        F.when(played, F.floor(F.col("o_totalprice") / 7).cast("long") % 4).alias("ag"),
        played.alias("played"),
    )


GAMES = """games AS (
  SELECT o_orderkey AS match_id, o_orderpriority AS league, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_orderdate AS DATE) AS kick_off,
    CAST(floor(1 + (dayofyear(o_orderdate) - 1) / 10) AS INTEGER) AS gameday, o_custkey % 20 AS home,
    (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 5 END AS hg,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 7) AS BIGINT) % 4 END AS ag,
    o_orderstatus <> 'P' AS played
  FROM orders)"""


def sides(games: DataFrame) -> DataFrame:
    """Perspective table: two rows a match, one for each side, with goals for and against."""
    def side(home_pitch, team, opp, gf, ga):
        return F.struct(F.lit(home_pitch).alias("home_pitch"), F.col(team).alias("team"), F.col(opp).alias("opp"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))

    both = F.explode(F.array(side(1, "home", "away", "hg", "ag"), side(0, "away", "home", "ag", "hg")))
    return games.select("match_id", "league", "season", "kick_off", "gameday", "played", both.alias("s")).select(
        "match_id", "league", "season", "kick_off", "gameday", "played", "s.*"
    )


SIDES = GAMES + """, sides AS (
  SELECT match_id, league, season, kick_off, gameday, played, 1 AS home_pitch, home AS team, away AS opp, hg AS gf, ag AS ga FROM games
  UNION ALL
  SELECT match_id, league, season, kick_off, gameday, played, 0, away, home, ag, hg FROM games)"""


def lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, player, home_pitch, substitute_in: one row for each player of a match."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player")).agg(
        F.min(F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0)).alias("home_pitch"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("substitute_in"),
    )


LINEUP = """lineup AS (
  SELECT l_orderkey AS match_id, l_suppkey AS player, min(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS home_pitch,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS substitute_in FROM lineitem GROUP BY 1, 2)"""


def scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, player, minute: one row for each goal."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player"), (1 + F.col("l_partkey") % 90).alias("minute")
    )


SCORERS = """scorers AS (
  SELECT l_orderkey AS match_id, l_suppkey AS player, 1 + l_partkey % 90 AS minute FROM lineitem WHERE l_quantity > 40)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fold, p (three probabilities that sum to 1), y (class that came)."""
    raw = [F.col("l_discount") + 0.01, F.col("l_tax") + 0.01, F.col("l_quantity") / 100]
    total = raw[0] + raw[1] + raw[2]
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.year("l_shipdate").alias("fold"),
        F.array(*[x / total for x in raw]).alias("p"),
        (F.col("l_linenumber") % 3).cast("int").alias("y"),
    )


FORECASTS = """forecasts AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CAST(year(l_shipdate) AS INTEGER) AS fold,
    [(l_discount + 0.01::DOUBLE) / t, (l_tax + 0.01::DOUBLE) / t, (l_quantity / 100) / t] AS p, CAST(l_linenumber % 3 AS INTEGER) AS y
  FROM (SELECT *, (l_discount + 0.01::DOUBLE) + (l_tax + 0.01::DOUBLE) + l_quantity / 100 AS t FROM lineitem))"""


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, side, minute, event_type, value, event_id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("match_id"), (F.col("event_id") % 2).alias("side"), (F.col("event_id") % 90).alias("minute"),
        "event_type", "value", "event_id",
    )


MATCH_EVENTS = "match_events AS (SELECT user_id AS match_id, event_id % 2 AS side, event_id % 90 AS minute, event_type, value, event_id FROM events)"


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (1 + F.col("p_size") / 10.0).alias("h"), (2.0 + F.col("p_partkey") % 5).alias("d"), (1.5 + F.col("p_partkey") % 7).alias("a")
    )


ODDS = "odds AS (SELECT p_partkey AS id, 1 + p_size / 10.0::DOUBLE AS h, 2.0::DOUBLE + p_partkey % 5 AS d, 1.5::DOUBLE + p_partkey % 7 AS a FROM part)"


def treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, treated (0/1), outcome, stratum, covariate (0/1)."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("treated"), F.col("n_chars").cast("double").alias("outcome"),
        F.col("lang").alias("stratum"), F.col("quality").alias("covariate"),
    )


TREATMENT = """treatment AS (
  SELECT doc_id AS id, toxic AS treated, CAST(n_chars AS DOUBLE) AS outcome, lang AS stratum, quality AS covariate FROM documents JOIN labels USING (doc_id))"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior draws: key (0..), factor, beta (64 draws, doubles)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("label").alias("factor"), F.transform("embedding", lambda x: x.cast("double")).alias("beta")
    )


DRAWS = "draws AS (SELECT vec_id AS key, label AS factor, CAST(embedding AS DOUBLE[]) AS beta FROM embeddings)"


def match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, side, minute and what an event feed tells of passes, shots, duels, dribbles, interceptions, clearances, fouls and substitutions;
    columns of other kinds of events are null."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    kind = lambda k, c: F.when(F.col("event_type") == k, c)
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (n % by + 1).cast("int"))
    third = lambda r, c: F.when((F.col("event_type") == "signup") & (F.floor(n / 10) % 3 == r), c)
    return e.select(
        F.col("user_id").alias("match_id"), (n % 2).cast("int").alias("side"), (F.floor(n / 2) % 95).cast("int").alias("minute"),
        kind("click", F.col("value")).alias("pass_length"), kind("click", F.when(F.floor(n / 3) % 5 == 0, F.lit("Incomplete"))).alias("pass_outcome"),
        kind("click", F.when(n % 7 == 0, F.lit(True))).alias("pass_shot_assist"), kind("click", F.when(n % 11 == 0, F.lit(True))).alias("pass_goal_assist"),
        kind("view", pick(5, "Goal", "Off T", "Wayward", "Saved", "Post")).alias("shot_outcome"),
        third(0, pick(4, "Won", "Lost In Play", "Success Out", "Lost Out")).alias("duel_outcome"), third(1, pick(4, "Success In Play", "Lost", "Won", "Success")).alias("interception_outcome"),
        third(2, pick(3, "Complete", "Incomplete", "Complete")).alias("dribble_outcome"),
        kind("purchase", F.when(n % 3 == 0, F.lit("Head"))).alias("clearance_body_part"), kind("purchase", F.when(n % 3 == 1, F.lit("Foul Out"))).alias("foul_committed_type"),
        kind("error", F.when(n % 4 > 0, F.lit("Tactical")).otherwise(F.lit("Injury"))).alias("substitution_outcome"),
    )


MATCH_DETAILS = """match_details AS (SELECT user_id AS match_id, CAST(event_id % 2 AS INTEGER) AS side, CAST((event_id // 2) % 95 AS INTEGER) AS minute,
  CASE WHEN event_type = 'click' THEN value END AS pass_length, CASE WHEN event_type = 'click' AND event_id // 3 % 5 = 0 THEN 'Incomplete' END AS pass_outcome,
  CASE WHEN event_type = 'click' AND event_id % 7 = 0 THEN true END AS pass_shot_assist, CASE WHEN event_type = 'click' AND event_id % 11 = 0 THEN true END AS pass_goal_assist,
  CASE WHEN event_type = 'view' THEN ['Goal', 'Off T', 'Wayward', 'Saved', 'Post'][event_id % 5 + 1] END AS shot_outcome,
  CASE WHEN event_type = 'signup' AND event_id // 10 % 3 = 0 THEN ['Won', 'Lost In Play', 'Success Out', 'Lost Out'][event_id % 4 + 1] END AS duel_outcome,
  CASE WHEN event_type = 'signup' AND event_id // 10 % 3 = 1 THEN ['Success In Play', 'Lost', 'Won', 'Success'][event_id % 4 + 1] END AS interception_outcome,
  CASE WHEN event_type = 'signup' AND event_id // 10 % 3 = 2 THEN ['Complete', 'Incomplete', 'Complete'][event_id % 3 + 1] END AS dribble_outcome,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'Head' END AS clearance_body_part, CASE WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'Foul Out' END AS foul_committed_type,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 > 0 THEN 'Tactical' ELSE 'Injury' END END AS substitution_outcome FROM events)"""
