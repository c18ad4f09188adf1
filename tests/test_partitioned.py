"""A batch rewrites what it touches, and a crash at any point leaves a whole table."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from touchline.operators import ledgers
from touchline.sources import partitioned, tables
from touchline.streaming import incremental

SF = "/root/testdata/sf0.001"
KEYS = ["league", "season"]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def latest(old, batch):
    return batch if old is None else ledgers.appended(old, batch, ["match_id"])


def games(spark):
    return tables.games(spark, SF).select("match_id", "league", "season", "gameday", "home", "away", "hg", "ag")


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_one_match_day_rewrites_one_partition(spark, tmp_path):
    g, p = games(spark), str(tmp_path / "t")
    partitioned.merge(g, p, KEYS, latest)
    before, parts = files(p), partitioned.manifest(spark, p).parts
    assert len(parts) == g.select(*KEYS).distinct().count() and rows(partitioned.read(spark, p)) == rows(g)
    day = g.where("league = '5-LOW' and season = 1996 and gameday = 7").withColumn("hg", F.lit(9).cast("long"))
    assert day.count() and partitioned.merge(day, p, KEYS, latest) == ['["5-LOW", 1996]']
    after = files(p)
    assert all(after[f] == t for f, t in before.items())  # no file was touched
    assert len({os.path.dirname(f) for f in after.keys() - before.keys()}) == 1
    changed = {k for k, f in partitioned.manifest(spark, p).parts.items() if parts[k] != f}
    assert changed == {'["5-LOW", 1996]'}
    assert rows(partitioned.read(spark, p)) == rows(ledgers.appended(g, day, ["match_id"]).select(g.columns))
    assert rows(partitioned.read(spark, p, ['["5-LOW", 1996]'])) == rows(partitioned.read(spark, p).where("league = '5-LOW' and season = 1996"))
    assert rows(partitioned.read(spark, p, number=0)) == rows(g)  # who began with the version before goes on
    partitioned.merge(day, p, KEYS, latest)
    assert partitioned.manifest(spark, p, 0) is None and not [f for f in files(p) if f not in after and "000000000002" not in f]


class Crash(RuntimeError):
    pass


def test_crashes_before_and_after_the_swap(spark, tmp_path, monkeypatch):
    p, one = str(tmp_path / "t"), lambda v: spark.createDataFrame([(1, "a", 1, v)], "match_id int, league string, season int, v string")

    def crash(*_):
        raise Crash

    partitioned.merge(one("x"), p, KEYS, latest, ("s", 0))
    with monkeypatch.context() as m:
        m.setattr(partitioned, "_publish", crash)
        with pytest.raises(Crash):
            partitioned.merge(one("y"), p, KEYS, latest, ("s", 1))
    assert [r.v for r in partitioned.read(spark, p).collect()] == ["x"] and len(os.listdir(f"{p}/parts")) == 2
    with monkeypatch.context() as m:
        m.setattr(partitioned, "sweep", crash)
        with pytest.raises(Crash):
            partitioned.merge(one("y"), p, KEYS, latest, ("s", 1))
    assert [r.v for r in partitioned.read(spark, p).collect()] == ["y"]
    assert partitioned.merge(one("z"), p, KEYS, latest, ("s", 1)) == []  # the batch is replayed, as after a crash
    assert [r.v for r in partitioned.read(spark, p).collect()] == ["y"]
    partitioned.merge(one("z"), p, KEYS, latest, ("s", 2), keep=1)
    assert [r.v for r in partitioned.read(spark, p).collect()] == ["z"] and len(os.listdir(f"{p}/parts")) == 1


def test_two_writers_do_not_lose_a_batch(spark, tmp_path):
    p, one = str(tmp_path / "t"), spark.createDataFrame([(1, "a", 1)], "match_id int, league string, season int")
    partitioned.merge(one, p, KEYS, latest)

    def slow(old, batch):
        partitioned.merge(one, p, KEYS, latest)  # the other one is through first
        return latest(old, batch)

    with pytest.raises(partitioned.Conflict):
        partitioned.merge(one, p, KEYS, slow)
    assert partitioned.manifest(spark, p).number == 1


def test_null_and_dated_keys_and_emptied_partitions(spark, tmp_path):
    p, day = str(tmp_path / "t"), datetime.date(2024, 5, 1)
    data = spark.createDataFrame([(1, None, day), (2, "a/b=c", None), (3, None, None)], "match_id int, league string, season date")
    partitioned.merge(data, p, KEYS, latest)
    assert rows(partitioned.read(spark, p)) == rows(data)
    gone = partitioned.merge(data.where("match_id = 2"), p, KEYS, lambda old, batch: old.join(batch.select("match_id"), "match_id", "left_anti"))
    assert gone == ['["a/b=c", null]'] and {r.match_id for r in partitioned.read(spark, p).collect()} == {1, 3}
    partitioned.merge(data.limit(0), p, KEYS, latest)
    partitioned.merge(data, p, KEYS, lambda old, batch: old.limit(0))
    assert partitioned.read(spark, p).collect() == [] and partitioned.read(spark, p).columns == data.columns
    assert partitioned.read(spark, str(tmp_path / "none")) is None


def test_raw_append_stream(spark, tmp_path):
    g, src, out, check = games(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    schema = g.schema.simpleString()[7:-1].replace(":", " ")
    g.where("season < 1998").write.parquet(src)

    def run():
        incremental.raw_append(incremental.files(spark, src, schema), out, ["match_id"], check).awaitTermination()

    run()
    before = partitioned.manifest(spark, out).parts
    late = g.where("season = 1997 and league = '1-URGENT'").withColumn("hg", F.lit(7).cast("long"))
    late.write.mode("append").parquet(src)
    run()
    after = partitioned.manifest(spark, out).parts
    assert {k for k in after if after[k] != before.get(k)} == {'["1-URGENT", 1997]'}
    assert rows(partitioned.read(spark, out)) == rows(ledgers.appended(g.where("season < 1998"), late, ["match_id"]).select(g.columns))
