"""Elo ratings of a stream of matches that may come late, be corrected or be moved: in whatever order they arrive, the ratings are those of
one fold over all matches in time order, season starts included.

Three tables are kept by league and season (`sources.partitioned`): the matches, their ratings, and the standing after the season, which
is every team's rating so far and the season it was last seen in. A batch puts its matches in place; then each touched league is rolled
back to the standing before its earliest touched season and folded again from there. So a batch of a running season reads
and writes that season's partition, and a late match those from its season on. Each table changes by one rename, and a batch that is
replayed, also after a crash between two tables, gives the same ratings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators import ledgers, ratings
from touchline.operators.relational import keep_last
from touchline.sources import partitioned
from touchline.streaming.incremental import start

KEYS = ["league", "season"]


@dataclass(frozen=True)
class Store:
    """Where the three tables lie."""

    path: str

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"


def _replace(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new


def _standings(before: DataFrame, seasons: DataFrame, last: DataFrame) -> DataFrame:
    """Standing after each of (league, season): of each team the newest of `before` (team, elo, seen) and the `last` of seasons so far."""
    known = before.select("league", "team", "elo", "seen").unionByName(last.select("league", "team", "elo", F.col("season").alias("seen")))
    grown = seasons.join(known.withColumnRenamed("league", "of"), (F.col("of") == F.col("league")) & (F.col("seen") <= F.col("season")))  # teams of a league
    return grown.groupBy("league", "season", "team").agg(F.max_by("elo", "seen").alias("elo"), F.max("seen").alias("seen"))


def absorb(batch: DataFrame, store: Store, rules: ratings.Rules = ratings.Rules()) -> list[str]:
    """Take a batch of matches (match_id, league, season, kick_off, home, away, hg, ag) in and rate anew what follows from it; returns the
    partitions whose ratings were written. Of a match that comes again in its league and season the newest row counts."""
    spark = batch.sparkSession
    columns = ["match_id", "league", "season", "kick_off", "home", "away", "hg", "ag"]
    batch = keep_last(batch.select(*columns), ["match_id"], [F.to_json(F.struct(*columns))])

    def placed(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else ledgers.appended(old, new, ["match_id"])

    touched = partitioned.merge(batch, store.at("matches"), KEYS, placed)
    first: dict[str, int] = {}
    for league, season in map(json.loads, touched):
        first[league] = min(first.get(league, season), season)
    if not first:
        return []
    names = sorted(partitioned.manifest(spark, store.at("matches")).parts)
    again = [n for n in names if json.loads(n)[0] in first and json.loads(n)[1] >= first[json.loads(n)[0]]]
    standing = partitioned.manifest(spark, store.at("standings"))
    newest: dict[str, str] = {}
    for n in sorted(standing.parts if standing else [], key=lambda n: json.loads(n)[1]):
        league, season = json.loads(n)
        if league in first and season < first[league]:
            newest[league] = n
    before = partitioned.read(spark, store.at("standings"), sorted(newest.values())) if standing else None
    if before is None:
        before = spark.createDataFrame([], f"league {batch.schema['league'].dataType.simpleString()}, season int, team long, elo double, seen int")
    games = partitioned.read(spark, store.at("matches"), again)
    rated = ratings.continued(games, before, rules)
    partitioned.merge(rated, store.at("ratings"), KEYS, _replace)
    rated = partitioned.read(spark, store.at("ratings"), again)
    seasons = games.select("league", F.col("season").cast("int").alias("season")).distinct()
    partitioned.merge(_standings(before, seasons, ratings.after(rated, games, rules)), store.at("standings"), KEYS, _replace)
    return again


def rate(stream: DataFrame, store: Store, checkpoint: str, rules: ratings.Rules = ratings.Rules()) -> StreamingQuery:
    """Rate a stream; read the ratings with partitioned.read(spark, store.at("ratings"))."""
    return start(stream, checkpoint, lambda batch, _: absorb(batch, store, rules))
