"""Scalars, filters, joins, aggregates, scaling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import association
from touchline.operators import relational as R
from touchline.operators import scaling as Z
from touchline.plans.registry import query
from touchline.plans.standings import PLAYER, PRIOR
from touchline.operators import features
from touchline.sources import tables as T
from touchline.sources.scratch import kept


@query("WITH " + T.GAMES + """, i AS (SELECT match_id, concat('L', left(league, 1), '-S', lpad(CAST(season % 100 * 100 + (season + 1) % 100 AS VARCHAR), 4, '0'),
  '_GD', CAST(gameday AS VARCHAR), CASE WHEN match_id % 7 = 0 THEN '-2' WHEN match_id % 5 = 0 THEN '.0' ELSE '' END, '_G', CAST(match_id % 10 AS VARCHAR)) AS id FROM games)
SELECT match_id, regexp_replace(id, '_GD([0-9]+)\\.0_', '_GD\\1_') AS id, string_split(id, '-S')[1] AS league, string_split(string_split(id, '-S')[2], '_')[1] AS season,
  CAST(CAST(string_split(substring(string_split(id, '_')[2], 3), '-')[1] AS DOUBLE) AS INTEGER) AS gameday, CAST(substring(string_split(id, '_')[3], 2) AS INTEGER) AS number,
  regexp_matches(id, 'GD[0-9]+-') AS in_parts, concat('20', substring(string_split(string_split(id, '-S')[2], '_')[1], 1, 2), '/', substring(string_split(string_split(id, '-S')[2], '_')[1], 3, 2)) AS label,
  concat(string_split(string_split(id, '-S')[2], '_')[1], '__', substring(string_split(string_split(id, '_')[2], '-')[1], 3)) AS season_day FROM i""".replace("\\\\", "\\"))
def match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build structured ids and take them apart again."""
    g = T.games(spark, sf_dir)
    code = F.lpad((F.col("season") % 100 * 100 + (F.col("season") + 1) % 100).cast("string"), 4, "0")
    tail = F.when(F.col("match_id") % 7 == 0, "-2").when(F.col("match_id") % 5 == 0, ".0").otherwise("")
    day = F.concat(F.col("gameday").cast("string"), tail)
    g = g.select("match_id", F.concat(F.lit("L"), F.substring("league", 1, 1), F.lit("-S"), code, F.lit("_GD"), day, F.lit("_G"), (F.col("match_id") % 10).cast("string")).alias("raw"))
    parts = S.parse_match_id(F.col("raw"))
    season_day = F.concat_ws("__", parts["season"], F.substring(F.split(F.split("raw", "_")[1], "-")[0], 3, 20))
    return g.select(
        "match_id", S.normalised_id(F.col("raw")).alias("id"), *[c.alias(n) for n, c in parts.items()], S.split_day(F.col("raw")).alias("in_parts"),
        S.season_label(parts["season"]).alias("label"), season_day.alias("season_day"),
    )


@query("WITH " + T.GAMES + """ SELECT match_id, CASE WHEN hg > ag THEN 2 WHEN hg < ag THEN 0 ELSE 1 END AS outcome, CASE WHEN hg IS NOT NULL THEN least(hg, 3) END AS capped,
  round(coalesce(hg / CASE WHEN ag = 0 THEN NULL ELSE CAST(ag AS DOUBLE) END, 0), 6) AS ratio, round(CASE WHEN hg <= 0 THEN 0 ELSE ln(hg) END, 6) AS log_goals,
  round(1 / (1 + exp(-CAST(hg - ag AS DOUBLE))), 6) AS logistic, round(ln(1 + exp(-abs(CAST(hg - ag AS DOUBLE)))) + greatest(hg - ag, 0), 6) AS softplus,
  round(1300 * CASE WHEN home IN (1, 2, 3) THEN 0.8 ELSE 1 END * CASE WHEN home IN (3, 4) THEN 0.75 ELSE 1 END * CASE WHEN home IN (5) THEN 0.6 ELSE 1 END, 6)::DOUBLE AS elo_scaled,
  CASE WHEN league = '5-LOW' THEN 0 ELSE 1 END AS home_pitch, CASE WHEN starts_with(league, '1') OR starts_with(league, '2') THEN 'qualifiers' ELSE 'finals' END AS competition FROM games""")
def scalar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards, caps, codes, multipliers and link functions."""
    d = (F.col("hg") - F.col("ag")).cast("double")
    lists = [([1, 2, 3], 0.8), ([3, 4], 0.75), ([5], 0.6)]
    return T.games(spark, sf_dir).select(
        "match_id", S.outcome(F.col("hg"), F.col("ag")).alias("outcome"), F.when(F.col("hg").isNotNull(), F.least("hg", F.lit(3).cast("long"))).alias("capped"),
        F.round(S.finite_or_zero(F.col("hg"), F.col("ag")), 6).alias("ratio"), F.round(S.log_guard(F.col("hg")), 6).alias("log_goals"),
        F.round(S.logistic(d), 6).alias("logistic"), F.round(S.softplus(d), 6).alias("softplus"),
        F.round(S.multiplied(F.lit(1300.0), F.col("home"), lists), 6).alias("elo_scaled"),
        F.when(F.col("league") == "5-LOW", 0).otherwise(1).alias("home_pitch"),
        F.when(F.startswith("league", F.lit("1")) | F.startswith("league", F.lit("2")), "qualifiers").otherwise("finals").alias("competition"),
    )


@query("WITH " + T.ODDS + """ SELECT id, round((1/a)/(1/a+1/d+1/h), 6) AS away, round((1/d)/(1/a+1/d+1/h), 6) AS draw, round((1/h)/(1/a+1/d+1/h), 6) AS home,
  round(1/h+1/d+1/a, 6) AS overround, CASE WHEN a <= d AND a <= h THEN 0 WHEN d <= h THEN 1 ELSE 2 END AS favourite FROM odds""")
def odds_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds to probabilities without the margin, and the favourite."""
    o = T.odds(spark, sf_dir).withColumn("p", S.implied(F.col("h"), F.col("d"), F.col("a")))
    best = F.when((F.col("a") <= F.col("d")) & (F.col("a") <= F.col("h")), 0).when(F.col("d") <= F.col("h"), 1).otherwise(2)
    return o.select(
        "id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("away", "draw", "home"))],
        F.round(S.overround(F.col("h"), F.col("d"), F.col("a")), 6).alias("overround"), best.alias("favourite"),
    )


@query("WITH " + T.GAMES + """, w AS (SELECT league, pow(0.5::DOUBLE, ((SELECT max(kick_off) FROM games) - kick_off) / 365.25::DOUBLE / 4) AS w FROM games)
SELECT league, round(sum(w), 4) AS effective, round(min(w), 6) AS least, count(*) AS n FROM w GROUP BY league""")
def time_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay weights with a half-life of four years, and the effective sample."""
    g = T.games(spark, sf_dir)
    g = g.crossJoin(F.broadcast(g.agg(F.max("kick_off").alias("last"))))
    w = g.withColumn("w", S.decay(F.col("kick_off"), F.col("last"), 4.0))
    return w.groupBy("league").agg(F.round(F.sum("w"), 4).alias("effective"), F.round(F.min("w"), 6).alias("least"), F.count("*").alias("n"))


@query("WITH " + T.GAMES + ", " + T.SCORERS + """ SELECT g.league, g.season, count(DISTINCT g.match_id) AS matches, sum(g.goals) AS goals, sum(coalesce(s.n, 0))::BIGINT AS identified,
  round(sum(coalesce(s.n, 0)) / CASE WHEN sum(g.goals) = 0 THEN NULL ELSE sum(g.goals)::DOUBLE END, 6) AS share
FROM (SELECT *, CAST(coalesce(hg, 0) + coalesce(ag, 0) AS BIGINT) AS goals FROM games) g LEFT JOIN (SELECT match_id, count(*) AS n FROM scorers GROUP BY 1) s USING (match_id) GROUP BY ALL""".replace("sum(g.goals) AS goals", "sum(g.goals)::BIGINT AS goals"))
def identified_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer rows against goals of the scores."""
    n = T.scorers(spark, sf_dir).groupBy("match_id").agg(F.count("*").alias("n"))
    g = T.games(spark, sf_dir).withColumn("goals", F.coalesce("hg", F.lit(0)) + F.coalesce("ag", F.lit(0))).join(n, "match_id", "left")
    known = F.sum(F.coalesce("n", F.lit(0)))
    return g.groupBy("league", "season").agg(
        F.countDistinct("match_id").alias("matches"), F.sum("goals").alias("goals"), known.alias("identified"),
        F.round(F.try_divide(known.cast("double"), F.sum("goals")), 6).alias("share"),
    )


@query("WITH " + T.GAMES + """, first AS (SELECT league, min(season) AS s FROM games GROUP BY 1), firsts AS (
  SELECT match_id FROM (SELECT match_id, row_number() OVER (PARTITION BY season, league ORDER BY kick_off, match_id) AS n FROM games) WHERE n <= 5)
SELECT g.match_id FROM games g JOIN first f USING (league) WHERE g.gameday > 3 AND g.season <> f.s AND g.match_id NOT IN (SELECT match_id FROM firsts)
  AND g.hg IS NOT NULL AND g.kick_off <= DATE '2000-01-01' + 14 AND g.league IN (SELECT DISTINCT league FROM games WHERE season <= 1998)""")
def filtered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn-in, first season out, horizon, leagues that training has seen, null drops."""
    g = T.games(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("season", "league").orderBy("kick_off", "match_id"))
    firsts = g.withColumn("n", n).where("n <= 5").select("match_id")
    g = g.withColumn("first_season", F.min("season").over(Window.partitionBy("league")))
    g = g.where("gameday > 3 and season <> first_season").join(firsts, "match_id", "left_anti").dropna(subset=["hg"])
    seen = T.games(spark, sf_dir).where("season <= 1998").select("league").distinct()
    return g.where(F.col("kick_off") <= F.date_add(F.lit("2000-01-01").cast("date"), 14)).join(seen, "league", "left_semi").select("match_id")


@query("WITH " + T.GAMES + """, f AS (SELECT DISTINCT season AS valid FROM games WHERE season > 1996)
SELECT f.valid, count(*) FILTER (g.season < f.valid) AS train, count(*) FILTER (g.season = f.valid) AS held FROM games g CROSS JOIN f GROUP BY f.valid""")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expanding-window folds: a fold trains on all earlier seasons; counted from one aggregate by season."""
    by = T.games(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"))
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row per season
    return by.select(F.col("season").alias("valid"), F.sum("n").over(w).alias("train"), F.col("n").alias("held")).where("valid > 1996")


@query("WITH " + T.SIDES + """, cut AS (SELECT * FROM sides WHERE NOT (home_pitch = 0 AND match_id % 3 = 0)),
lone AS (SELECT * FROM cut QUALIFY count(*) OVER (PARTITION BY match_id) = 1)
SELECT match_id, home_pitch, team, opp, gf, ga, false AS added FROM cut UNION ALL SELECT match_id, 1 - home_pitch, opp, team, ga, gf, true FROM lone""")
def mirrored_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches seen from one side get the other."""
    cut = T.sides(T.games(spark, sf_dir)).where("not (home_pitch = 0 and match_id % 3 = 0)").select("match_id", "home_pitch", "team", "opp", "gf", "ga")
    both = R.mirrored(cut)
    return both.withColumn("added", (F.col("home_pitch") == 0) & (F.col("match_id") % 3 == 0))


@query("WITH " + PLAYER + """, latest AS (SELECT player, arg_max(team, struct_pack(g := gameday, m := match_id)) AS team, max(gameday) AS gameday FROM player GROUP BY player),
best AS (SELECT team, player, sum(goals)::BIGINT AS goals, row_number() OVER (PARTITION BY team ORDER BY sum(goals) DESC, player) AS n FROM player GROUP BY team, player)
SELECT b.team, b.player, b.goals, CAST(b.n AS INTEGER) AS n, l.team AS latest_team FROM best b JOIN latest l USING (player) WHERE b.n <= 3""")
def best_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best scorers of a team, and the team of a player's latest match day."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    latest = rows.groupBy("player").agg(F.max_by("team", F.struct("gameday", "match_id")).alias("latest_team"))
    sums = rows.groupBy("team", "player").agg(F.sum("goals").alias("goals"))
    top = sums.withColumn("n", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("goals"), "player"))).where("n <= 3")
    return top.join(latest, "player").select("team", "player", "goals", "n", "latest_team")


@query("WITH " + T.GAMES + """, e AS (SELECT season, home, away, match_id, kick_off FROM games), last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY season, home, away ORDER BY kick_off DESC, match_id DESC) = 1),
first AS (SELECT season, home, away, match_id AS first_id FROM e QUALIFY row_number() OVER (PARTITION BY season, home, away ORDER BY kick_off, match_id) = 1)
SELECT l.season, l.home, l.away, l.match_id AS last_id, f.first_id, count(*) OVER (PARTITION BY l.season, l.home) AS opponents FROM last l JOIN first f USING (season, home, away)""")
def deduplicated_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the last and the first of repeated pairings."""
    e = T.games(spark, sf_dir).select("season", "home", "away", "match_id", "kick_off")
    key, order = ["season", "home", "away"], [F.col("kick_off"), F.col("match_id")]
    last = R.keep_last(e, key, order).select(*key, F.col("match_id").alias("last_id"))
    first = R.keep_first(e, key, order).select(*key, F.col("match_id").alias("first_id"))
    return last.join(first, key).withColumn("opponents", F.count("*").over(Window.partitionBy("season", "home")))


@query("WITH " + T.GAMES + """, a AS (SELECT DISTINCT home AS team, season FROM games WHERE league = '1-URGENT'), b AS (SELECT DISTINCT away AS team, season FROM games WHERE league = '5-LOW' AND gameday < 20)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on keys."""
    g = T.games(spark, sf_dir)
    a = g.where("league = '1-URGENT'").select(F.col("home").alias("team"), "season").distinct()
    b = g.where("league = '5-LOW' and gameday < 20").select(F.col("away").alias("team"), "season").distinct()
    said = {"union": a.union(b).distinct(), "except": a.exceptAll(b), "intersect": a.intersect(b), "union all": a.unionByName(b, allowMissingColumns=True)}
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in said.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("WITH " + T.GAMES + """, t AS (SELECT DISTINCT league, home AS team FROM games), p AS (SELECT a.league, a.team AS home, b.team AS away FROM t a JOIN t b ON a.league = b.league AND a.team <> b.team),
n AS (SELECT league, home, away, count(*) AS n FROM games GROUP BY ALL), d AS (SELECT team, CAST(row_number() OVER (ORDER BY team) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT home AS team FROM games WHERE season < 1997))
SELECT p.league, p.home, p.away, coalesce(n.n, 0) AS n, coalesce(x.code, -1) AS home_code FROM p LEFT JOIN n USING (league, home, away) LEFT JOIN d x ON x.team = p.home""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of a league's teams (a few dozen), how often they met, and their codes, -1 for new ones."""
    g = T.games(spark, sf_dir)
    t = g.select("league", F.col("home").alias("team")).distinct()
    pairs = t.withColumnRenamed("team", "home").join(t.withColumnRenamed("team", "away"), "league").where("home <> away")
    n = g.groupBy("league", "home", "away").agg(F.count("*").alias("n"))
    code = g.where("season < 1997").select("home").distinct().withColumn("home_code", F.row_number().over(Window.orderBy("home")) - 1)
    out = pairs.join(n, ["league", "home", "away"], "left").join(F.broadcast(code), "home", "left")
    return out.select("league", "home", "away", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("home_code", F.lit(-1)).alias("home_code"))


@query("WITH " + T.TREATMENT + """, t AS (SELECT id, outcome AS s FROM treatment WHERE treated = 1), c AS (SELECT id AS c, outcome AS s FROM treatment WHERE treated = 0)
SELECT t.id, arg_min(c.c, struct_pack(g := abs(c.s - t.s), s := c.s, i := c.c)) AS control, min(abs(c.s - t.s)) AS gap FROM t CROSS JOIN c GROUP BY t.id""")
def nearest_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control with the nearest score for each treated row, without a cross join."""
    t = T.treatment(spark, sf_dir).select("id", F.col("outcome").alias("s"), "treated")
    return R.nearest(t.where("treated = 1"), t.where("treated = 0"), "s")


@query("WITH " + T.SIDES + """ SELECT league, count(*) AS n, round(avg(gf), 6) AS mean, round(stddev_samp(gf), 6) AS sd, round(skewness(gf), 6) AS skew, round(kurtosis(gf), 6) AS kurt,
  round(quantile_cont(gf::DOUBLE, 0.05), 6) AS q05, round(quantile_cont(gf::DOUBLE, 0.25), 6) AS q25, round(median(gf::DOUBLE), 6) AS q50, round(quantile_cont(gf::DOUBLE, 0.95), 6) AS q95,
  round(corr(gf, ga), 6) AS corr_goals, round(avg(CASE WHEN gf = 0 THEN 1 ELSE 0 END), 6) AS zeros, round(regr_slope(gf, gameday), 6) AS slope, round(regr_intercept(gf, gameday), 6) AS intercept,
  count(DISTINCT team) AS teams FROM sides WHERE gf IS NOT NULL GROUP BY league""")
def goal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected moments, exact quantiles, correlation, share of zeros, trend line."""
    s = T.sides(T.games(spark, sf_dir)).where("gf is not null")
    moments = [F.round(c, 6).alias(n) for c, n in zip(R.moments_corrected("gf"), ("mean", "sd", "skew", "kurt"), strict=True)]
    quantiles = [F.round(F.percentile("gf", F.lit(q)), 6).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.95)]
    return s.groupBy("league").agg(
        F.count("*").alias("n"), *moments, *quantiles, F.round(F.corr("gf", "ga"), 6).alias("corr_goals"),
        F.round(F.avg(F.when(F.col("gf") == 0, 1).otherwise(0)), 6).alias("zeros"), F.round(F.regr_slope("gf", "gameday"), 6).alias("slope"),
        F.round(F.regr_intercept("gf", "gameday"), 6).alias("intercept"), F.countDistinct("team").alias("teams"),
    )


@query("WITH " + T.SIDES + """, n AS (SELECT gf, count(*) AS n FROM sides WHERE gf IS NOT NULL GROUP BY gf)
SELECT gf, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(sum(n) OVER (ORDER BY gf) / sum(n) OVER ()::DOUBLE, 6) AS running FROM n""")
def goal_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency table with shares and running shares."""
    f = R.frequencies(T.sides(T.games(spark, sf_dir)).where("gf is not null"), "gf")
    return f.select("gf", "n", F.round("share", 6).alias("share"), F.round("running", 6).alias("running"))


@query("WITH " + T.SIDES + """, n AS (SELECT league, team, opp, count(*) AS n FROM sides GROUP BY ALL)
SELECT league, team, arg_min(opp, struct_pack(a := -n, b := opp)) AS opp, max(n) AS n FROM n GROUP BY league, team""")
def usual_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode by group, ties to the smallest."""
    return R.mode(T.sides(T.games(spark, sf_dir)), ["league", "team"], "opp")


@query("WITH " + T.GAMES + """, b AS (SELECT CAST(ceil((hg + ag) / 1.0::DOUBLE) AS INTEGER) AS bin FROM games WHERE hg IS NOT NULL), n AS (SELECT bin, count(*) AS n FROM b WHERE bin BETWEEN 1 AND 9 GROUP BY bin)
SELECT CAST(r.i AS INTEGER) AS bin, round(n.n / (SELECT sum(n) FROM n)::DOUBLE, 6) AS share FROM range(1, 10) r(i) LEFT JOIN n ON n.bin = r.i""")
def goals_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open histogram, empty bins null."""
    g = T.games(spark, sf_dir).where("hg is not null").withColumn("x", F.col("hg") + F.col("ag"))
    return R.histogram(g, "x", 0.0, 1.0, 9).withColumn("share", F.round("share", 6))


@query("WITH " + T.GAMES + """ SELECT coalesce(CAST(bucket AS VARCHAR), 'all') AS bucket, min(hg) AS low, max(hg) AS high, count(*) AS n, round(avg(hg), 6) AS mean
FROM (SELECT *, CASE WHEN gameday <= 2 THEN '01-02' WHEN gameday <= 10 THEN '03-10' WHEN gameday <= 20 THEN '11-20' ELSE '21-99' END AS bucket FROM games) GROUP BY ROLLUP (bucket)""")
def gameday_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of match days with a total row."""
    day = F.col("gameday")
    bucket = F.when(day <= 2, "01-02").when(day <= 10, "03-10").when(day <= 20, "11-20").otherwise("21-99")
    g = T.games(spark, sf_dir).withColumn("bucket", bucket).rollup("bucket")
    out = g.agg(F.min("hg").alias("low"), F.max("hg").alias("high"), F.count("*").alias("n"), F.round(F.avg("hg"), 6).alias("mean"))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


@query("WITH " + T.SIDES + """ SELECT league, season, array_to_string(list_sort(list(DISTINCT team)), ',') AS teams, arg_min(match_id, struct_pack(k := kick_off, m := match_id)) AS opener,
  count(*) FILTER (team % 2 = 0 AND home_pitch = 1) AS even_home, count(*) FILTER (team % 2 = 1 AND home_pitch = 1) AS odd_home FROM sides GROUP BY league, season""")
def season_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted team lists and first matches by season, and a pivot of counts."""
    s = T.sides(T.games(spark, sf_dir))
    start = s.groupBy("league", "season").agg(
        F.array_join(F.array_sort(F.collect_set("team")), ",").alias("teams"), F.min_by("match_id", F.struct("kick_off", "match_id")).alias("opener")
    )
    home = s.where("home_pitch = 1").withColumn("kind", F.when(F.col("team") % 2 == 0, "even_home").otherwise("odd_home"))
    pivot = home.groupBy("league", "season").pivot("kind", ["even_home", "odd_home"]).count()
    return start.join(pivot.fillna(0), ["league", "season"])


@query("WITH " + PLAYER + """, k AS (SELECT CASE WHEN substitute_in = 1 THEN 'replacement' ELSE 'elite' END AS type, least(goals, 5) AS g FROM player)
SELECT type, g, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY type)::DOUBLE, 6) AS share_of_type, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM k GROUP BY type, g""")
def elite_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal frequencies of two kinds of players with window totals over the small table."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    n = rows.groupBy(
        F.when(F.col("substitute_in") == 1, "replacement").otherwise("elite").alias("type"), F.least("goals", F.lit(5).cast("long")).alias("g")
    ).agg(F.count("*").alias("n"))
    of_type, whole = F.sum("n").over(Window.partitionBy("type")), F.sum("n").over(Window.partitionBy())
    return n.withColumns({"share_of_type": F.round(F.col("n") / of_type, 6), "share": F.round(F.col("n") / whole, 6)})


@query("WITH " + PLAYER + """, t AS (SELECT season, player, sum(goals)::BIGINT AS goals FROM player GROUP BY ALL), m AS (SELECT season, median(goals) AS med FROM t GROUP BY season)
SELECT season, player, goals, CASE WHEN med = 0 THEN NULL ELSE abs(goals - med) / med > 0.25 END AS outlier FROM t JOIN m USING (season)""")
def density_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values more than a quarter off the season's median."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    t = rows.groupBy("season", "player").agg(F.sum("goals").alias("goals"))
    m = t.groupBy("season").agg(F.median("goals").alias("med"))
    return t.join(m, "season").select("season", "player", "goals", (F.try_divide(F.abs(F.col("goals") - F.col("med")), F.col("med")) > 0.25).alias("outlier"))


@query("WITH " + PRIOR + """, z AS (SELECT match_id, home_pitch,
  (points_team - avg(points_team) OVER a) / CASE WHEN stddev_samp(points_team) OVER a > 0 THEN stddev_samp(points_team) OVER a ELSE 1 END AS z1,
  CASE WHEN stddev_samp(points_team) OVER b > 0 THEN (points_team - avg(points_team) OVER b) / stddev_samp(points_team) OVER b ELSE 0 END AS z2,
  CASE WHEN stddev_samp(points_team) OVER c > 0 THEN (points_team - avg(points_team) OVER c) / stddev_samp(points_team) OVER c ELSE 0 END AS z3
  FROM pre WINDOW a AS (PARTITION BY season, league, gameday), b AS (PARTITION BY season, gameday), c AS (PARTITION BY gameday))
SELECT match_id, home_pitch, round(z1, 6) AS z1, round(z2, 6) AS z2, round(z3, 6) AS z3 FROM z""")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sectional z-scores by three groupings, each with its rule for degenerate groups."""
    pre = out = kept(features.pre_match(T.sides(T.games(spark, sf_dir))).select("match_id", "home_pitch", "season", "league", "gameday", "points_team"))
    for i, (groups, degenerate) in enumerate(((["season", "league", "gameday"], "unit"), (["season", "gameday"], "zero"), (["gameday"], "zero")), 1):
        out = Z.scaled(out, "points_team", groups, f"z{i}", degenerate, pre)
    return out.select("match_id", "home_pitch", *[F.round(f"z{i}", 6).alias(f"z{i}") for i in (1, 2, 3)])


@query("WITH " + PRIOR + """, m AS (SELECT gameday, avg(points_team) AS mean, stddev_samp(points_team) AS sd FROM pre WHERE season < 2000 AND gameday <= 30 GROUP BY gameday)
SELECT p.match_id, p.home_pitch, round(coalesce((p.points_team - m.mean) / CASE WHEN m.sd = 0 THEN NULL ELSE m.sd END, 0), 6) AS z FROM pre p LEFT JOIN m ON m.gameday = least(p.gameday, 30) WHERE p.season >= 2000""")
def z_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training moments by match day applied to later seasons, days clipped to the last one trained."""
    pre = features.pre_match(T.sides(T.games(spark, sf_dir)))
    table = Z.moments(pre.where("season < 2000 and gameday <= 30"), ["points_team"], ["gameday"])
    return Z.frozen(pre.where("season >= 2000"), table, ["points_team"], "gameday").select("match_id", "home_pitch", F.round("points_team_z", 6).alias("z"))


@query("""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, stddev_pop(o_totalprice) AS p, min(o_totalprice) AS l, max(o_totalprice) AS h FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z, round((o_totalprice - m) / p, 6) AS z_pop, round((o_totalprice - l) / (h - l), 6) AS unit, round(o_totalprice, 2) AS back FROM orders, s""")
def z_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-sample z-scores with either deviation, min-max, and the inverse."""
    z = Z.whole(T.table(spark, sf_dir, "orders"), "o_totalprice")
    return z.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("z", "z_pop", "unit")], F.round("back", 2).alias("back"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links,
  regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parse stage of a scrape, by patterns on the page's text."""
    count = lambda p, g: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(g))).cast("long")
    return T.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<p>", 0).alias("paragraphs"),
        count('href="([^"]*)"', 1).alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


FEATURES = ["quantity", "price", "discount", "tax"]


@query("WITH x AS (SELECT l_returnflag AS flag, [CAST(l_quantity AS DOUBLE), l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_discount END, l_tax] AS v FROM lineitem), p AS (SELECT a.i AS i, b.i AS j FROM range(1, 5) a(i) JOIN range(1, 5) b(i) ON a.i < b.i)"
  " SELECT flag, " + " || ', ' || ".join(f"['quantity', 'price', 'discount', 'tax'][{k}]" for k in ("i", "j")) + " AS pair, count(*) FILTER (v[i] IS NOT NULL AND v[j] IS NOT NULL) AS n, round(corr(v[i], v[j]), 6) AS corr FROM x CROSS JOIN p GROUP BY flag, i, j")
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation matrix of features by group, pairwise complete."""
    x = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"),
    )
    c = association.correlations(x, FEATURES, ("flag",))
    name = lambda k: F.element_at(F.array(*map(F.lit, FEATURES)), (F.col(k) + 1).cast("int"))
    return c.select("flag", F.concat_ws(", ", name("i"), name("j")).alias("pair"), "n", F.round("corr", 6).alias("corr"))
