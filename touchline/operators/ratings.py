"""Elo ratings: a fold over the matches of a league in time order.

The fold is path-dependent, so the matches of a league stream through one task in time order, leagues in parallel; the task holds
one number per team, never the matches. Four choices set the variants apart and are parameters: who counts as returning, what a
newcomer gets, whether matches without a score move ratings, and which seasons are frozen.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.sources.scratch import kept

RATED = "match_id long, league string, season int, home_elo double, away_elo double"
#: What a fold of a slice gives: RATED, then rows without a match that hold a team's rating and the season it was last seen in.
CARRIED = RATED + ", team long, elo double"
#: Matches in a slice of time, which is what tasks sort and fold at once.
AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Rules:
    start: float = 1300.0  #: newcomers
    keep: float = 0.75  #: share of last season's rating that a returning team keeps
    pull: float = 375.0  #: added to it
    step: float = 20.0
    advantage: float = 50.0
    returning: str = "previous"  #: 'previous' season or 'ever' seen
    unplayed: str = "draw"  #: matches without a score count as a 'draw' or are 'frozen'
    frozen: tuple[int, ...] = ()  #: seasons whose matches read ratings but do not move them
    resets: bool = True


def expected(home: Column, away: Column, advantage: float = 50.0) -> Column:
    """Expected score of the home team."""
    return 1 / (1 + F.pow(F.lit(10.0), (away - home - advantage) / 400))


def updated(home: Column, away: Column, result: Column, step: float = 20.0, advantage: float = 50.0) -> tuple[Column, Column]:
    """Both ratings after a match; what one gains the other loses. result: 1 home win, 0.5 draw, 0 away win."""
    gain = step * (result - expected(home, away, advantage))
    return home + gain, away - gain


def gain(home: float, away: float, hg: float | None, ag: float | None, step: float = 20.0, advantage: float = 50.0) -> float:
    """What the home team gains and the away team loses; a match without a score counts as a draw."""
    result = 0.5 if hg is None or ag is None or hg == ag else float(hg > ag)
    return step * (result - 1 / (1 + 10 ** ((away - home - advantage) / 400)))


@dataclass
class Ratings:
    """Ratings of one fold: a team's number, the season it was last seen in, and the teams of the season before."""

    rules: Rules
    rating: dict[int, float] = field(default_factory=dict)
    seen: dict[int, int] = field(default_factory=dict)

    def before(self, team: int, season: int) -> float:
        """The team's rating as it goes into a match; its first match of a season begins with the season's reset."""
        rules, last = self.rules, self.seen.get(team)
        if rules.resets and last != season:
            known = last is not None and (rules.returning == "ever" or last == season - 1)
            self.rating[team] = rules.keep * self.rating[team] + rules.pull if known else rules.start
        self.seen[team] = season
        return self.rating.setdefault(team, rules.start)

    def play(self, season: int, home: int, away: int, hg: int | None, ag: int | None) -> tuple[float, float]:
        """Both ratings before the match; then it moves them."""
        h, a = self.before(home, season), self.before(away, season)
        missing = hg is None or ag is None
        if season not in self.rules.frozen and not (missing and self.rules.unplayed == "frozen"):
            g = gain(h, a, hg, ag, self.rules.step, self.rules.advantage)
            self.rating[home], self.rating[away] = h + g, a - g
        return h, a


def _folded(rules: Rules, apart: bool):
    """Batches in order of league (if apart), time -> CARRIED. Rows with a team and an elo set that team's rating, and with a season when it was
    last seen."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
    names = [c.split()[0] for c in CARRIED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def standing(state: Ratings, league: str | None) -> list[tuple]:
        return [(None, league, state.seen.get(t), None, None, t, v) for t, v in state.rating.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, league = Ratings(rules), None
        for b in batches:
            out = []
            for name, season, match, home, away, hg, ag, team, elo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if apart and name != league:
                    out += standing(state, league)
                    state, league = Ratings(rules), name
                if team is not None:
                    state.rating[team] = elo
                    if season is not None:
                        state.seen[team] = season
                else:
                    out.append((match, name, season, *state.play(season, home, away, hg, ag), None, None))
            yield batch(out)
        yield batch(standing(state, league))

    return run


def _rows(games: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).cast("long").alias(c)
    return games.select(
        "league", F.col("season").cast("int").alias("season"), number("match_id"), number("home"), number("away"), number("hg"), number("ag"),
        F.lit(None).cast("long").alias("team"), F.lit(None).cast("double").alias("elo"), "kick_off",
    )


def _fold(rows: DataFrame, rules: Rules, key: list[str]) -> DataFrame:
    order = [*key, F.col("kick_off").asc_nulls_first(), "match_id"]
    dealt = rows.repartition(*key) if key else rows.repartition(1)
    return dealt.sortWithinPartitions(*order).drop("kick_off").mapInArrow(_folded(rules, bool(key)), CARRIED)


def _stream(rows: DataFrame, rules: Rules, key: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """One fold over all rows in time order. Beyond `at_once` matches they are cut into slices of time of that size at most, about equal;
    a slice starts from the ratings that the one before left, a row a team. So what a task sorts does not grow with the history."""
    matches = rows.where("match_id is not null")
    slices = -(-matches.count() // at_once)
    if slices <= 1:
        return _fold(rows, rules, key).where("match_id is not null").drop("team", "elo")
    time = [F.col("kick_off").asc_nulls_first(), "match_id"]
    cut = kept(matches.repartitionByRange(slices, *time).withColumn("slice", F.spark_partition_id()))
    state, done = rows.where("match_id is null"), []
    for k in range(slices):
        part = kept(_fold(cut.where(F.col("slice") == k).drop("slice").unionByName(state), rules, key))
        state = _standing(part.where("match_id is null").select("league", "team", "elo", F.col("season").alias("seen")))
        done.append(part.where("match_id is not null").drop("team", "elo"))
    return functools.reduce(DataFrame.union, done)


def elo(games: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Ratings of both teams before each match, one update per match: RATED."""
    return _stream(_rows(games), rules, ["league"])


def elo_global(games: DataFrame, rules: Rules = Rules(resets=False, unplayed="frozen")) -> DataFrame:
    """One chronological rating over all leagues. A match needs the outcome of those before it, so one task reads all of them.

    The task streams, slice by slice of time: it holds a number per team, and sorts AT_ONCE matches whatever the length of the history. Some
    77,000 matches a second were measured on a core that also had other work (300,000 matches), so ten million take about two minutes.
    """
    return _stream(_rows(games.where("hg is not null")), rules, [])


def _standing(ratings: DataFrame) -> DataFrame:
    """Stored ratings(league, team, elo[, seen]) as rows that come first in time."""
    seen = F.col("seen") if "seen" in ratings.columns else F.lit(None)
    return ratings.select(
        "league", seen.cast("int").alias("season"), *[F.lit(None).cast("long").alias(c) for c in ("match_id", "home", "away", "hg", "ag")],
        F.col("team").cast("long").alias("team"), F.col("elo").cast("double").alias("elo"), F.lit(None).cast("date").alias("kick_off"),
    )


def continued(games: DataFrame, ratings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """RATED of games that follow on stored ratings(league, team, elo, seen), seen the season of a team's last match."""
    return _stream(_rows(games).unionByName(_standing(ratings)), rules, ["league"])


def after(rated: DataFrame, games: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Ratings (league, season, team, elo) after each team's last match of a season, from the ratings before all of its matches."""
    g = games.select("match_id", "kick_off", F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "hg", "ag")
    rows = rated.join(g, "match_id")
    unplayed = F.col("hg").isNull() | F.col("ag").isNull()
    result = F.when(unplayed | (F.col("hg") == F.col("ag")), 0.5).when(F.col("hg") > F.col("ag"), 1.0).otherwise(0.0)
    still = F.col("season").isin(*rules.frozen) if rules.frozen else F.lit(False)
    still = still | unplayed if rules.unplayed == "frozen" else still
    home, away = updated(F.col("home_elo"), F.col("away_elo"), result, rules.step, rules.advantage)
    side = lambda team, before, now: F.struct(F.col(team).alias("team"), F.when(still, F.col(before)).otherwise(now).alias("elo"))
    sides = rows.select("league", "season", "kick_off", "match_id", F.explode(F.array(side("home", "home_elo", home), side("away", "away_elo", away))).alias("s"))
    order = F.struct(F.col("kick_off").isNotNull(), "kick_off", "match_id")
    return sides.groupBy("league", "season", F.col("s.team").alias("team")).agg(F.max_by("s.elo", order).alias("elo"))


def resumed(games: DataFrame, ratings: DataFrame, since: str, rules: Rules = Rules(resets=False, unplayed="frozen")) -> DataFrame:
    """Roll only the matches on or after `since` on from stored ratings(league, team, elo), which come first in time."""
    newer = _rows(games.where(F.col("kick_off") >= F.lit(since).cast("date")))
    return _stream(newer.unionByName(_standing(ratings)), rules, ["league"])
