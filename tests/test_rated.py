"""Ratings of a stream in any order of arrival against one fold over all matches."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import ratings
from touchline.sources import partitioned, tables
from touchline.streaming import incremental, rated

SF = "/root/testdata/sf0.001"


def games(spark):
    g = tables.games(spark, SF).where("league in ('1-URGENT', '5-LOW') and season < 1998")
    return g.select("match_id", "league", "season", "kick_off", "home", "away", "hg", "ag")


def close(got, want):
    got, want = ({r.match_id: (r.home_elo, r.away_elo) for r in d.collect()} for d in (got, want))
    return set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in got)


@pytest.mark.parametrize("rules", [ratings.Rules(), ratings.Rules(returning="ever", unplayed="frozen", frozen=(1996,))])
def test_any_order_of_arrival(spark, tmp_path, rules):
    g, store = games(spark).cache(), rated.Store(str(tmp_path / "s"))
    rows = g.collect()
    random.Random(3).shuffle(rows)
    for i in range(0, len(rows), len(rows) // 3 + 1):
        rated.absorb(spark.createDataFrame(rows[i : i + len(rows) // 3 + 1], g.schema), store, rules)
    assert close(partitioned.read(spark, store.at("ratings")), ratings.elo(g, rules))


def test_late_and_corrected_matches_roll_back_no_further_than_they_must(spark, tmp_path):
    g, store = games(spark).cache(), rated.Store(str(tmp_path / "s"))
    late = g.where("league = '5-LOW' and season = 1996").orderBy("kick_off").limit(3)
    rated.absorb(g.join(late, "match_id", "left_anti"), store)
    before = partitioned.manifest(spark, store.at("ratings")).parts
    assert rated.absorb(late, store) == ['["5-LOW", 1996]', '["5-LOW", 1997]']
    after = partitioned.manifest(spark, store.at("ratings")).parts
    assert {k for k in after if after[k] != before[k]} == {'["5-LOW", 1996]', '["5-LOW", 1997]'}
    assert close(partitioned.read(spark, store.at("ratings")), ratings.elo(g))
    fixed = g.where("season = 1997 and league = '1-URGENT' and hg is not null").orderBy("match_id").limit(1).withColumns({"hg": F.lit(9).cast("long"), "kick_off": F.date_add("kick_off", -40)})
    assert rated.absorb(fixed, store) == ['["1-URGENT", 1997]']
    assert close(partitioned.read(spark, store.at("ratings")), ratings.elo(g.join(fixed, "match_id", "left_anti").unionByName(fixed)))
    assert rated.absorb(fixed.limit(0), store) == []


def test_a_crash_between_the_tables_and_a_replay(spark, tmp_path, monkeypatch):
    g, store = games(spark).where("league = '5-LOW' and season < 1997").cache(), rated.Store(str(tmp_path / "s"))
    one, two = g.where("match_id % 2 = 0"), g.where("match_id % 2 = 1")
    rated.absorb(one, store)
    merge, calls = partitioned.merge, []

    def failing(*args, **more):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return merge(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(partitioned, "merge", failing)
        with pytest.raises(RuntimeError):
            rated.absorb(two, store)
    rated.absorb(two, store)
    assert close(partitioned.read(spark, store.at("ratings")), ratings.elo(g))


def test_stream(spark, tmp_path):
    g, src, store = games(spark).where("season < 1997").cache(), str(tmp_path / "in"), rated.Store(str(tmp_path / "s"))
    schema = g.schema.simpleString()[7:-1].replace(":", " ")
    for part in ("match_id % 3 = 1", "match_id % 3 = 0", "match_id % 3 = 2"):
        g.where(part).coalesce(1).write.mode("append").parquet(src)
        rated.rate(incremental.files(spark, src, schema), store, str(tmp_path / "c")).awaitTermination()
    assert close(partitioned.read(spark, store.at("ratings")), ratings.elo(g))
