"""League tables: cumulative standings, pre-match as-of lookups and average-tie ranks, as windows over a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["league", "season"]
SUMS = ["played_n", "won", "drawn", "lost", "gf", "ga", "points"]


def match_points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def ladder(sides: DataFrame) -> DataFrame:
    """Standings of every home team after every match day of its league and season; matches without a score count nothing.

    Goals are summed per match day first, then one window per team runs over a dense team x match-day grid (a few dozen rows a
    team), so no partition grows with the table.
    """
    gf, ga, done = F.col("gf"), F.col("ga"), F.col("gf").isNotNull() & F.col("ga").isNotNull()
    count = lambda c: F.sum(F.when(done & c, 1).otherwise(0))
    days = sides.groupBy(*KEYS, "gameday", "team").agg(
        count(F.lit(True)).alias("played_n"), count(gf > ga).alias("won"), count(gf == ga).alias("drawn"), count(gf < ga).alias("lost"),
        F.sum(F.when(done, gf).otherwise(0)).alias("gf"), F.sum(F.when(done, ga).otherwise(0)).alias("ga"),
        F.sum(F.when(done, match_points(gf, ga)).otherwise(0)).alias("points"),
    )
    teams = sides.where("home_pitch = 1").select(*KEYS, "team").distinct()
    grid = teams.join(sides.select(*KEYS, "gameday").distinct(), KEYS)
    run = Window.partitionBy(*KEYS, "team").orderBy("gameday").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = grid.join(days, [*KEYS, "gameday", "team"], "left")
    out = dense.select(*KEYS, "gameday", "team", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(run).cast("long").alias(c) for c in SUMS])
    return out.withColumn("balance", F.col("gf") - F.col("ga"))


def average_rank(value: Column, *partition: str) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2.0


def ranked(table: DataFrame) -> DataFrame:
    """Goal ranks within a match day: scored counts down from the number of teams, conceded counts up; and their whole parts."""
    part = [*KEYS, "gameday"]
    teams = F.count("*").over(Window.partitionBy(*part))
    scored, conceded = teams - average_rank(F.col("gf"), *part), average_rank(F.col("ga"), *part)
    return table.withColumn("scored_rank", scored).withColumn("conceded_rank", conceded).withColumn(
        "scored_rank_int", F.floor("scored_rank").cast("int")
    ).withColumn("conceded_rank_int", F.floor("conceded_rank").cast("int"))


def before_day(table: DataFrame, columns: list[str]) -> DataFrame:
    """Standings as they were before each match day, that is, at the last one before it.

    The table is dense (every team on every match day of its season), so this is a lag in the window order the sums already have.
    """
    w = Window.partitionBy(*KEYS, "team").orderBy("gameday")
    return table.select(*KEYS, "gameday", "team", *[F.lag(c).over(w).alias(c) for c in columns])


def prior_standing(sides: DataFrame, table: DataFrame, columns: list[str], suffix: str, team: str = "team") -> DataFrame:
    """Join to each row the standing of `team` before its match day; zeros before the first."""
    snap = before_day(table, columns)
    snap = snap.select(*KEYS, "gameday", F.col("team").alias(team), *[F.col(c).alias(c + suffix) for c in columns])
    rows = sides.join(snap, [*KEYS, "gameday", team], "left")
    return rows.withColumns({c + suffix: F.coalesce(c + suffix, F.lit(0)) for c in columns})


def rank_without(value: Column, others: Column, own: Column) -> Column:
    """Scored-rank of `value` among the `others` (array, own team's entry `own` included): teams minus average rank."""
    less = F.size(F.filter(others, lambda x: x < value)) - F.when(own < value, 1).otherwise(0)
    equal = F.size(F.filter(others, lambda x: x == value)) - F.when(own == value, 1).otherwise(0)
    return F.size(others) - (less + (equal + 2) / 2.0)
