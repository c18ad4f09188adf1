"""Scans: typed CSV and JSON, partitioned league-season folders, vintages, increments. Every reader takes a schema; none infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GAMES = "match_id string, kick_off date, team_home string, team_away string, score_home_full double, score_away_full double, score_home_half double, score_away_half double"
SCORERS = "match_id string, name_player string, name_team string, minute int"
LINEUP = "match_id string, name_player string, name_team string, substitute_in int, substitute_out int"
PLAYERS = (
    "season string, name_player string, position_player string, date_of_birth date, N_games_left int, N_games_center int, N_games_right int, "
    "height_player string, weight_player string, nationality_player string"
)
EVENTS = (
    "match_id long, team string, team_id long, minute int, shot_outcome string, pass_outcome string, pass_length double, pass_shot_assist string, "
    "pass_goal_assist string, dribble_outcome string, duel_outcome string, interception_outcome string, clearance_body_part string, "
    "foul_committed_type string, substitution_outcome string, substitution_replacement string"
)
ODDS = "id_match string, season string, AvgH double, AvgD double, AvgA double, MaxH double, MaxD double, MaxA double"


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in all floating columns: a missing score must not group or sort as a number."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def csv(spark: SparkSession, path: str | list[str], schema: str | StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; `columns` are all that is parsed of a row."""
    df = without_nan(spark.read.schema(schema).option("header", True).csv(path))
    return df.select(*columns) if columns else df


def events(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.schema(EVENTS).json(path))


def seasons(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """root/<league>/S<season>_<kind>.csv of all leagues and seasons, with league and season from the path and prefixed match ids."""
    df = csv(spark, f"{root}/*/S*_{kind}.csv", schema)
    where = F.col("_metadata.file_path")
    df = df.select(
        F.regexp_extract(where, r"/([^/]+)/S[^/]+$", 1).alias("league"), F.regexp_extract(where, r"/S([0-9]+)_[^/]+$", 1).alias("season"), *df.columns
    )
    return df.withColumn("match_id", F.concat_ws("-", "league", "match_id"))


def vintages(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All dated outputs of a job with the date of their file name as `as_of`."""
    df = csv(spark, glob, schema)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)
    return df.select(*df.columns, F.to_date(F.when(name != "", name)).alias("as_of"))


def since(df: DataFrame, stored: DataFrame | None, day: str) -> DataFrame:
    """Rows from the last stored day on: a scan that resumes; the mark is one aggregate."""
    if stored is None:
        return df
    mark = stored.agg(F.max(day).alias("_mark"))
    return df.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(day) >= F.col("_mark"))).drop("_mark")


def fixtures(games: DataFrame, today: str) -> DataFrame:
    """Matches that are not played yet as of a date."""
    return games.where(F.col("kick_off") >= F.to_date(F.lit(today)))


def jsonld_matches(pages: DataFrame, html: str = "html") -> DataFrame:
    """The parse stage of a scrape: JSON-LD sports events out of raw pages. Fetching is not part of the engine."""
    block = F.explode(F.regexp_extract_all(html, F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1)))
    schema = "name string, startDate string, homeTeam struct<name:string>, awayTeam struct<name:string>"
    doc = pages.withColumn("_block", block).withColumn("e", F.from_json("_block", schema))
    return doc.select(
        *[c for c in pages.columns if c != html], F.col("e.name").alias("name"), F.try_to_timestamp("e.startDate").alias("kick_off"),
        F.col("e.homeTeam.name").alias("home"), F.col("e.awayTeam.name").alias("away"),
    )
