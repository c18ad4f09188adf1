"""Ledgers, sinks, readers and streaming forms: replays change nothing, played rows stay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.operators import ledgers, ratings, relational
from touchline.sources import partitioned, readers, sinks, tables
from touchline.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_player_ledger(spark):
    schema = "id_match string, name_player string, p double, status string, forecast_frozen_at string, actual_goals long, appeared boolean"
    old = spark.createDataFrame([("m0", "a", 0.1, "finished", "1", 2, True), ("m1", "a", 0.2, "upcoming", "1", None, None), ("m1", "b", 0.3, "upcoming", "1", None, None)], schema)
    board = spark.createDataFrame([("m2", "a", 0.5), ("m0", "a", 0.9)], "id_match string, name_player string, p double")
    played = spark.createDataFrame([("m0",), ("m1",)], "id_match string")
    scored = spark.createDataFrame([("m1", "a", 1), ("m1", "c", 2)], "id_match string, name_player string, goals long")
    got = {(r.id_match, r.name_player): r for r in ledgers.player_ledger(old, board, played, scored, F.lit("2")).collect()}
    assert got["m0", "a"].p == 0.1 and got["m0", "a"].actual_goals == 2
    assert got["m1", "a"].actual_goals == 1 and got["m1", "a"].appeared and got["m1", "b"].actual_goals == 0 and not got["m1", "b"].appeared
    assert got["m1", "c"].p is None and got["m1", "c"].status == "finished"
    assert got["m2", "a"].status == "upcoming" and got["m2", "a"].forecast_frozen_at == "2" and len(got) == 5
    again = ledgers.player_ledger(ledgers.player_ledger(old, board, played, scored, F.lit("2")), board, played, scored, F.lit("3"))
    assert {(r.id_match, r.name_player, r.actual_goals) for r in again.collect() if r.status == "finished"} == {
        (k[0], k[1], r.actual_goals) for k, r in got.items() if r.status == "finished"
    }


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    sinks.append_deduplicated(a, p, ["k"])
    sinks.append_deduplicated(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), p, ["k"])
    now = lambda: {tuple(r) for r in sinks.current(spark, p).collect()}
    assert now() == {(1, "x"), (2, "z"), (3, "w")}
    broken = tmp_path / "t" / "version=000000000002"  # a crash in the middle of a write
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"PAR1")
    half = tmp_path / "old" / "vintage=2024-01-01"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"PAR1")
    assert now() == {(1, "x"), (2, "z"), (3, "w")}
    sinks.append_deduplicated(spark.createDataFrame([(3, "u")], "k int, v string"), p, ["k"])
    assert now() == {(1, "x"), (2, "z"), (3, "u")} and len(sinks.versions(spark, p)) == 2
    assert sinks.archive(spark, p, str(tmp_path / "old"), "2024-01-01") and not sinks.archive(spark, p, str(tmp_path / "old"), "2024-01-01")
    d = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    for _ in range(2):
        sinks.track(d, str(tmp_path / "tr"), "day")
    sinks.track(spark.createDataFrame([("d2", 5)], "day string, n int"), str(tmp_path / "tr"), "day")
    assert {(r.day, r.n) for r in spark.read.parquet(str(tmp_path / "tr")).collect()} == {("d1", 1), ("d2", 5)}
    assert sinks.markdown(a, 1).startswith("| k | v |\n|---|---|\n| 1 | x |")


def test_overwrite_and_bundle(spark, tmp_path):
    p = str(tmp_path / "csv")
    for n in (3, 2):
        sinks.overwrite(spark.range(n).selectExpr("id", "id * 1.5 as x"), p, "csv", header="true")
    assert sorted(tuple(r) for r in readers.csv(spark, p, "id long, x double").collect()) == [(0, 0.0), (1, 1.5)]
    assert readers.csv(spark, p, "id long, x double", ["x"]).columns == ["x"]
    b, settings = str(tmp_path / "bundle"), {"elo": {"K": 20, "home": 50}, "factors": ["a", "b"], "golden": [[0.1, 0.9]]}
    sinks.save_bundle(spark, b, {"draws": tables.draws(spark, SF).limit(5), "codes": spark.range(3)}, settings)
    got, said = sinks.load_bundle(spark, b)
    assert said == settings and set(got) == {"draws", "codes"} and got["draws"].count() == 5 and len(got["draws"].first().beta) == 64


def test_event_scan(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"match_id": 7, "team": "A", "minute": 12, "pass_length": 3.5, "shot_outcome": "Goal"}\n{"match_id": 7, "team": "B", "pass_length": NaN, "other": 1}\n')
    rows = readers.events(spark, str(tmp_path / "e.json")).orderBy("team").collect()
    assert [(r.match_id, r.team, r.minute, r.pass_length, r.shot_outcome) for r in rows] == [(7, "A", 12, 3.5, "Goal"), (7, "B", None, None, None)]


def test_simulated_effects(spark):
    """The known effect of the simulator comes back by adjustment for what drives the substitution, not by the plain difference."""
    from touchline.operators import causal

    rows = causal.simulate(spark, 40_000, 3).cache()
    known = rows.where("sub = 1").agg(F.avg("ite")).first()[0]
    by_score = causal.true_effects(rows, "score_diff").agg(F.sum(F.col("att") * F.col("n")) / F.sum("n")).first()[0]
    assert abs(by_score - known) < 1e-9
    centre = rows.where("sub = 1").agg(F.avg("off_old")).first()[0]  # the effect depends on the strength: at the treated mean it is theirs
    varied = rows.withColumn("varied", F.col("sub") * (F.col("off_old") - centre))
    fit = {r.term: r.estimate for r in causal.regression(varied, "passes", ["sub", "off_old", "score_diff", "varied"]).collect()}
    plain = causal.effects_by(rows.withColumnsRenamed({"sub": "treated", "passes": "outcome"})).first().effect
    assert abs(fit["sub"] - known) < 0.2 < abs(plain - known)
    rows.unpersist()


def test_readers(spark, tmp_path):
    folder = tmp_path / "raw" / "PL"
    folder.mkdir(parents=True)
    (folder / "S2425_scorers.csv").write_text("match_id,name_player,name_team,minute\nS2425_GD1_G1,a,T,12\n")
    r = readers.seasons(spark, str(tmp_path / "raw"), "scorers", readers.SCORERS).first()
    assert (r.league, r.season, r.match_id, r.minute) == ("PL", "2425", "PL-S2425_GD1_G1", 12)
    (tmp_path / "board_2024-05-01.csv").write_text("id_match,season,AvgH,AvgD,AvgA,MaxH,MaxD,MaxA\nm,2425,1.5,NaN,6,1,1,1\n")
    v = readers.vintages(spark, str(tmp_path / "board_*.csv"), readers.ODDS).first()
    assert v.as_of == dt.date(2024, 5, 1) and v.AvgD is None
    page = spark.createDataFrame([(1, '<script type="application/ld+json">{"name":"A - B","startDate":"2024-08-16T20:00:00Z","homeTeam":{"name":"A"},"awayTeam":{"name":"B"}}</script>')], "page_id int, html string")
    m = readers.jsonld_matches(page).first()
    assert (m.home, m.away, m.page_id) == ("A", "B", 1)
    g = tables.games(spark, SF)
    assert readers.since(g, g.where("kick_off < '2000-01-01'"), "kick_off").agg(F.min("kick_off")).first()[0] >= dt.date(1999, 12, 1)
    assert readers.fixtures(g, "2001-01-01").count() > 0


def test_stream_append_and_ledger(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    g = tables.games(spark, SF).where("season = 2000")
    fresh = g.select("season", "home", "away", F.lit(1).alias("p"))
    schema = "season int, home long, away long, p int"
    fresh.limit(50).write.parquet(src)
    played = lambda: g.where("gameday <= 20")
    incremental.ledger(incremental.files(spark, src, schema), out, played, str(tmp_path / "c")).awaitTermination()
    first = {tuple(r) for r in partitioned.read(spark, out).collect()}
    fresh.withColumn("p", F.lit(2)).write.mode("append").parquet(src)
    incremental.ledger(incremental.files(spark, src, schema), out, played, str(tmp_path / "c")).awaitTermination()
    done = {(r.season, r.home, r.away) for r in played().collect()}
    now = {tuple(r) for r in partitioned.read(spark, out).collect()}
    assert {r for r in now if r[:3] in done and r[3] == 1} == {r for r in first if r[:3] in done}
    assert all(r[3] == 2 for r in now if r[:3] not in done)


def test_stream_elo(spark, tmp_path):
    g = tables.games(spark, SF).where("season = 1995 and hg is not null").select("match_id", "league", "season", "kick_off", "home", "away", "hg", "ag")
    src = str(tmp_path / "in")
    g.where("gameday is null or kick_off < '1995-06-01'" if "gameday" in g.columns else "kick_off < '1995-06-01'").write.parquet(src)
    schema = g.schema.simpleString()[7:-1].replace(":", " ")

    def run():
        q = incremental.elo(incremental.files(spark, src, schema)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
            "checkpointLocation", str(tmp_path / "c")
        ).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    g.where("kick_off >= '1995-06-01'").write.mode("append").parquet(src)
    run()
    want = {r.match_id: (r.home_elo, r.away_elo) for r in ratings.elo(g, ratings.Rules(resets=False)).collect()}
    got = {r.match_id: (r.home_elo, r.away_elo) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_elo_zero_sum_and_leagues(spark):
    h, a = spark.range(1).select(*ratings.updated(F.lit(1500.0), F.lit(1400.0), F.lit(1.0))).first()
    assert h + a == pytest.approx(2900) and h > 1500
    empty = tables.games(spark, SF).limit(0)
    assert ratings.elo(empty).count() == 0


def test_nearest_control_ties_and_empty(spark):
    t = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, 9.0)], "id long, s double")
    c = spark.createDataFrame([(10, 4.0), (11, 6.0), (12, 4.0)], "id long, s double")
    assert {(r.id, r.control, r.gap) for r in relational.nearest(t, c, "s").collect()} == {(1, 10, 1.0), (2, 10, 4.0), (3, 11, 3.0)}
