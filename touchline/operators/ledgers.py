"""Forecast ledgers that never rewrite a played match, snapshots and trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.relational import keep_last

MATCH_KEY = ["season", "home", "away"]


def refreshed(ledger: DataFrame, fresh: DataFrame, played: DataFrame, key: list[str] = MATCH_KEY) -> DataFrame:
    """Rows of played matches stay as they are; all others are replaced by fresh forecasts where there are any.

    The key is the pairing, not the match id: ids change when a match is moved.
    """
    frozen = ledger.join(played.select(*key).distinct(), key, "left_semi")
    waiting = ledger.join(played.select(*key).distinct(), key, "left_anti").join(fresh.select(*key).distinct(), key, "left_anti")
    new = fresh.join(frozen.select(*key).distinct(), key, "left_anti")
    return frozen.unionByName(waiting, True).unionByName(new, True)


def player_ledger(ledger: DataFrame, board: DataFrame, played: DataFrame, scored: DataFrame, now: Column) -> DataFrame:
    """Four sources, one row per (id_match, name_player), the most final status first.

    Finished rows are kept. Upcoming rows whose match was played get their goals (0 without any) and whether the player appeared;
    scorers that were never forecast join with null probabilities; the rest is today's board.
    """
    key = ["id_match", "name_player"]
    done = played.select("id_match").distinct()
    goals = scored.groupBy(*key).agg(F.sum("goals").alias("g"))
    finished = ledger.where("status = 'finished'").withColumn("_rank", F.lit(0))
    due = ledger.where("status = 'upcoming'").join(done, "id_match", "left_semi").join(goals, key, "left")
    due = due.withColumns({"actual_goals": F.coalesce("g", F.lit(0).cast("long")), "appeared": F.col("g").isNotNull(), "status": F.lit("finished")}).drop("g")
    unseen = goals.join(done, "id_match", "left_semi").join(ledger.select(*key), key, "left_anti").select(
        *key, F.lit("finished").alias("status"), F.col("g").alias("actual_goals"), F.lit(True).alias("appeared")
    )
    open_ = board.join(done, "id_match", "left_anti").withColumns({"status": F.lit("upcoming"), "forecast_frozen_at": now})
    out = finished.unionByName(due.withColumn("_rank", F.lit(1)), True).unionByName(unseen.withColumn("_rank", F.lit(2)), True)
    out = out.unionByName(open_.withColumn("_rank", F.lit(3)), True)
    w = Window.partitionBy(*key).orderBy("_rank", F.desc_nulls_last("forecast_frozen_at"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def rebuilt(vintages: DataFrame, kick_off: str, stamp: str, key: list[str] = MATCH_KEY) -> DataFrame:
    """From all vintages the latest forecast of each match that was made before kick-off."""
    return keep_last(vintages.where(F.col(stamp) < F.col(kick_off)), key, [F.col(stamp)])


def tracked(tracker: DataFrame, today: DataFrame, day: str) -> DataFrame:
    """Replace the rows of today's date, keep all other days: running twice changes nothing."""
    return tracker.join(today.select(day).distinct(), day, "left_anti").unionByName(today)


def appended(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows, of equal keys the new one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), True)
    return keep_last(both, key, [F.col("_batch")]).drop("_batch")


def cascaded(parents: DataFrame, children: DataFrame, key: list[str], order: list[Column], id: str) -> tuple[DataFrame, DataFrame]:
    """Keep the last of repeated parents and drop the children of those removed."""
    kept = keep_last(parents, key, order)
    return kept, children.join(kept.select(id), id, "left_semi")
