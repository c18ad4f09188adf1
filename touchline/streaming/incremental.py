"""Streaming forms: raw files in, ladders, ratings and ledgers kept up to date. Each takes a streaming DataFrame and a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators import ledgers
from touchline.operators.ratings import gain
from touchline.operators.relational import keep_last
from touchline.sources import partitioned


def files(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options: str) -> DataFrame:
    """New files of a folder as a stream; the checkpoint of the query is the mark up to which a scan has come."""
    return spark.readStream.schema(schema).options(**options).format(format).load(path)


def start(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w).start()


PARTITIONS = ["league", "season"]


def raw_append(stream: DataFrame, path: str, key: list[str], checkpoint: str, partitions: list[str] = PARTITIONS) -> StreamingQuery:
    """Append batches to a table, the newest row of each key stays. Only the partitions that a batch touches are rewritten, and a batch
    that is replayed changes nothing. Read it with partitioned.read(). Of the same key in one batch the last row by all columns stays."""

    def how(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        batch = keep_last(batch, key, [F.to_json(F.struct(*batch.columns))])
        return batch if old is None else ledgers.appended(old, batch, key)

    return start(stream, checkpoint, lambda batch, n: partitioned.merge(batch, path, partitions, how, (checkpoint, n)))


def ledger(stream: DataFrame, path: str, played: Callable[[], DataFrame], checkpoint: str, partitions: list[str] = ledgers.MATCH_KEY[:1]) -> StreamingQuery:
    """Merge batches of forecasts into a ledger whose played rows never change; read it with partitioned.read(). Partitions are part of
    the ledger's key, so those that a batch does not touch cannot change."""

    def how(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        fresh = batch.dropDuplicates(ledgers.MATCH_KEY)
        return fresh if old is None else ledgers.refreshed(old, fresh, played())

    return start(stream, checkpoint, lambda batch, n: partitioned.merge(batch, path, partitions, how, (checkpoint, n)))


def recomputed(stream: DataFrame, history: Callable[[], DataFrame], derive: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Late and moved matches rewrite history, so each batch recomputes whole league-seasons that it touches, and only those."""

    def redo(batch: DataFrame, _: int) -> None:
        touched = batch.select("league", "season").distinct()
        table = derive(history().join(touched, ["league", "season"], "left_semi"))
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league", "season").parquet(out)

    return start(stream, checkpoint, redo)


def running_points(stream: DataFrame) -> DataFrame:
    """Points and matches by league, season and team as a streaming aggregate (update or complete mode)."""
    from touchline.operators.ladder import match_points

    points = match_points(F.col("gf"), F.col("ga"))
    return stream.where("gf is not null").groupBy("league", "season", "team").agg(F.sum(points).alias("points"), F.count("*").alias("n"))


ELO_ROWS = "league string, match_id long, home_elo double, away_elo double"
ELO_STATE = "ratings string"


def elo(stream: DataFrame, start_rating: float = 1300.0, step: float = 20.0, advantage: float = 50.0) -> DataFrame:
    """Ratings carried as state per league; a batch's matches are folded in time order. State is one number per team."""
    import json

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rating = json.loads(state.get[0]) if state.exists else {}
        games = pd.concat(list(batches)).sort_values(["kick_off", "match_id"], kind="stable")
        out = []
        for g in games.itertuples():
            h, a = rating.get(str(g.home), start_rating), rating.get(str(g.away), start_rating)
            out.append((key[0], g.match_id, h, a))
            if not (pd.isna(g.hg) or pd.isna(g.ag)):
                moved = gain(h, a, g.hg, g.ag, step, advantage)
                rating[str(g.home)], rating[str(g.away)] = h + moved, a - moved
        state.update((json.dumps(rating),))
        yield pd.DataFrame(out, columns=["league", "match_id", "home_elo", "away_elo"])

    return stream.groupBy("league").applyInPandasWithState(fold, ELO_ROWS, ELO_STATE, "append", GroupStateTimeout.NoTimeout)
