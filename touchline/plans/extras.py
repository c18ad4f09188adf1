"""Smaller operators: titles and dates, shares of the pitch, composite strength, pairings, legacy look-ups, boards and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.functions import scoring
from touchline.operators import causal, counts, evaluation, features
from touchline.operators import ledgers as L
from touchline.plans.registry import query
from touchline.plans.standings import PLAYER
from touchline.sources import readers
from touchline.sources import tables as T
from touchline.sources.scratch import kept


@query("""SELECT o_orderkey, concat(upper(substring(o_orderstatus, 1, 1)), ' ', 'Side') AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy FROM orders""")
def titles_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs to titles, dates parsed, formatted and cut to the month."""
    o = T.table(spark, sf_dir, "orders")
    slug = F.concat(F.lower("o_orderstatus"), F.lit("-side"))
    day = F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd")
    return o.select(
        "o_orderkey", S.title(slug).alias("title"), F.date_format(day, "yyyy-MM-dd").alias("day"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"), F.dayofyear("o_orderdate").alias("doy"),
    )


@query("""WITH n AS (SELECT l_suppkey AS player, count(*) FILTER (l_linenumber = 1 AND l_quantity > 25) AS l, count(*) FILTER (l_linenumber = 2 AND l_quantity > 25) AS c, count(*) FILTER (l_linenumber = 3 AND l_quantity > 25) AS r FROM lineitem GROUP BY 1)
SELECT player, round(l / nullif(l + c + r, 0)::DOUBLE, 6) AS left_share, CASE WHEN (l + 0.5::DOUBLE * c) / nullif(l + c + r, 0) > 0.66 THEN 'left' WHEN (l + 0.5::DOUBLE * c) / nullif(l + c + r, 0) > 0.33 THEN 'centre'
  WHEN l + c + r > 0 THEN 'right' END AS side FROM n""")
def pitch_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of appearances left, centre and right, and the usual side; null without any."""
    n = [F.count_if((F.col("l_linenumber") == i) & (F.col("l_quantity") > 25)).alias(k) for i, k in ((1, "l"), (2, "c"), (3, "r"))]
    p = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player")).agg(*n)
    total = F.col("l") + F.col("c") + F.col("r")
    return p.select("player", F.round(F.try_divide(F.col("l"), total), 6).alias("left_share"), S.side_of_pitch(F.col("l"), F.col("c"), F.col("r")).alias("side"))


@query("WITH " + T.MATCH_EVENTS + """, k AS (SELECT match_id, side, unnest(['click', 'view', 'signup', 'purchase', 'error']) AS kind FROM (SELECT DISTINCT match_id, side FROM match_events)),
r AS (SELECT k.match_id, k.side, k.kind, count(*) FILTER (e.value > 50) / nullif(count(e.value), 0)::DOUBLE AS rate FROM k LEFT JOIN match_events e ON e.match_id = k.match_id AND e.side = k.side AND e.event_type = k.kind GROUP BY ALL)
SELECT match_id, side, round(CASE WHEN count(rate) = 5 THEN sum(0.2::DOUBLE * rate) END, 6) AS strength FROM r GROUP BY match_id, side""")
def composite_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each of five success rates; null if one of them is undefined."""
    e = T.match_events(spark, sf_dir)
    kinds = ["click", "view", "signup", "purchase", "error"]
    rate = lambda k: F.try_divide(F.count_if((F.col("event_type") == k) & (F.col("value") > 50)).cast("double"), F.count_if((F.col("event_type") == k) & F.col("value").isNotNull()))
    total = sum((0.2 * rate(k) for k in kinds[1:]), 0.2 * rate(kinds[0]))
    return e.groupBy("match_id", "side").agg(F.round(total, 6).alias("strength"))


@query("WITH " + PLAYER + """, r AS (SELECT season, player, sum(goals) OVER (PARTITION BY league, season, player ORDER BY kick_off, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / nullif(sum(goals) OVER (PARTITION BY league, season, team ORDER BY kick_off, match_id, player ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS share FROM player)
SELECT season, count(*) AS n, round(avg(share), 6) AS mean FROM r WHERE share <= 1 AND season < 2001 GROUP BY season""")
def integrity_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose share is at most 1 (null drops out), the sealed season left alone."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    own = F.sum("goals").over(Window.partitionBy("league", "season", "player").orderBy("kick_off", "match_id").rowsBetween(Window.unboundedPreceding, -1))
    team = F.sum("goals").over(Window.partitionBy("league", "season", "team").orderBy("kick_off", "match_id", "player").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("share", F.try_divide(own.cast("double"), team)).where("share <= 1").where("season < 2001")
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean"))


@query("WITH " + T.SIDES + """ SELECT h.match_id, h.team AS home, a.team AS away, h.gf AS hg, a.gf AS ag FROM sides h JOIN sides a ON h.match_id = a.match_id AND h.home_pitch = 1 AND a.home_pitch = 0""")
def paired_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both perspectives of a match back on one row, by one conditional aggregate instead of a self-join."""
    s = T.sides(T.games(spark, sf_dir))
    at = lambda c, p, n: F.max(F.when(F.col("home_pitch") == p, F.col(c))).alias(n)
    return s.groupBy("match_id").agg(at("team", 1, "home"), at("team", 0, "away"), at("gf", 1, "hg"), at("gf", 0, "ag"))


@query("WITH " + T.SIDES + """, d AS (SELECT league, season, team, kick_off, sum(gf) AS gf, count(*) FILTER (gf > ga) AS won FROM sides GROUP BY ALL), r AS (
  SELECT *, sum(gf) OVER (PARTITION BY league, season, team ORDER BY kick_off) AS total FROM d) SELECT league, season, team, CAST(kick_off AS VARCHAR) AS kick_off,
  CAST(coalesce(lag(total) OVER (PARTITION BY league, season, team ORDER BY kick_off), 0) AS BIGINT) AS before FROM r""")
def legacy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing one row earlier in the team's table; 0 on the first row."""
    d = T.sides(T.games(spark, sf_dir)).groupBy("league", "season", "team", "kick_off").agg(F.sum("gf").alias("gf"))
    w = Window.partitionBy("league", "season", "team").orderBy("kick_off")
    d = d.withColumn("total", F.sum("gf").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.select("league", "season", "team", F.col("kick_off").cast("string").alias("kick_off"), F.coalesce(F.lag("total").over(w), F.lit(0)).cast("long").alias("before"))


@query("WITH " + T.GAMES + """ SELECT t.team, count(*) AS n FROM (SELECT DISTINCT home AS team FROM games WHERE hg - ag >= 3) t JOIN games g ON g.home = t.team OR g.away = t.team GROUP BY t.team""")
def matches_of_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, on either side, of the teams that have won at home by three goals, as an equi-join on the perspective table."""
    g = T.games(spark, sf_dir)
    teams = g.where("hg - ag >= 3").select(F.col("home").alias("team")).distinct()
    return T.sides(g).join(teams, "team").groupBy("team").agg(F.count("*").alias("n"))


@query("WITH " + PLAYER + """, first AS (SELECT DISTINCT player FROM player ORDER BY player LIMIT 5) SELECT concat(CAST(season AS VARCHAR), '/', lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) AS season, player, count(*) AS n
FROM player JOIN first USING (player) WHERE concat(CAST(season AS VARCHAR), '/', lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) <= '1997/98' GROUP BY ALL""")
def smoke_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five players, seasons compared as text."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    first = rows.select("player").distinct().orderBy("player").limit(5)
    label = F.concat(F.col("season").cast("string"), F.lit("/"), F.lpad(((F.col("season") + 1) % 100).cast("string"), 2, "0"))
    out = rows.join(F.broadcast(first), "player").withColumn("season", label).where("season <= '1997/98'")
    return out.groupBy("season", "player").agg(F.count("*").alias("n"))


@query("WITH " + PLAYER + """, open AS (SELECT CAST(match_id AS VARCHAR) AS id_match, CAST(player AS VARCHAR) AS name_player FROM player WHERE player % 3 <> 0),
scored AS (SELECT CAST(match_id AS VARCHAR) AS id_match, CAST(player AS VARCHAR) AS name_player, CAST(sum(goals) AS BIGINT) AS g FROM player WHERE goals > 0 GROUP BY ALL)
SELECT coalesce(o.id_match, g.id_match) AS id_match, coalesce(o.name_player, g.name_player) AS name_player, coalesce(g.g, 0) AS actual_goals, g.g IS NOT NULL AS appeared, CASE WHEN o.id_match IS NULL THEN NULL ELSE 0.5 END::DOUBLE AS p FROM open o FULL JOIN scored g USING (id_match, name_player)""")
def player_ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: forecasts of played matches become final (a third of the players had none); scorers without a forecast join with a null probability."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    rows = kept(rows.select("match_id", "player", "goals"))  # appearances are joined once; what follows reads them three times
    key = [F.col("match_id").cast("string").alias("id_match"), F.col("player").cast("string").alias("name_player")]
    ledger = rows.where("player % 3 <> 0").select(
        *key, F.lit(0.5).alias("p"), F.lit("upcoming").alias("status"), F.lit("1").alias("forecast_frozen_at"), F.lit(None).cast("long").alias("actual_goals"),
        F.lit(None).cast("boolean").alias("appeared"),
    )
    scored = rows.where("goals > 0").select(*key, "goals")
    out = L.player_ledger(ledger, ledger.select("id_match", "name_player", "p").limit(0), rows.select(key[0]), scored, F.lit("2"))
    return out.select("id_match", "name_player", "actual_goals", "appeared", "p")


@query("WITH " + T.DRAWS + """, e AS (SELECT key, list_transform(range(0, 32), lambda d: 0.1::DOUBLE + beta[2 * d + 1] * 0.5 + beta[2 * d + 2] * -0.25) AS eta FROM draws)
SELECT key, round(list_avg(eta), 6) AS eta_mean, round(list_min(eta), 6) AS eta_low, round(list_max(eta), 6) AS eta_high FROM e""")
def linear_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: base plus factors times coefficients for every draw, two numbers of the row a draw."""
    b = F.col("beta")
    by_draw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda d: F.array(F.get(b, 2 * d), F.get(b, 2 * d + 1)))
    rows = T.draws(spark, sf_dir).select("key", F.lit(0.1).alias("base"), F.array(F.lit(0.5), F.lit(-0.25)).alias("x"), by_draw.alias("by_draw"))
    eta = counts.linear_predictor(rows, "x", "by_draw", "base")
    mean = scoring.total(F.col("eta")) / F.size("eta")
    return eta.select("key", F.round(mean, 6).alias("eta_mean"), F.round(F.array_min("eta"), 6).alias("eta_low"), F.round(F.array_max("eta"), 6).alias("eta_high"))


@query("WITH " + PLAYER + """ SELECT season, player, round(avg(goals) / nullif(avg(0.2::DOUBLE + match_id % 5 / 10.0::DOUBLE), 0), 6) AS excess FROM player GROUP BY season, player""")
def excess_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill over mean predicted probability by player and season."""
    rows = features.player_goals(T.games(spark, sf_dir), T.lineup(spark, sf_dir), T.scorers(spark, sf_dir))
    p = F.lit(0.2) + F.col("match_id") % 5 / 10.0
    return rows.groupBy("season", "player").agg(F.round(F.try_divide(F.avg("goals"), F.avg(p)), 6).alias("excess"))


@query("WITH " + T.FORECASTS + """, a AS (SELECT count(*) AS n, avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS p FROM forecasts) SELECT n, round(p, 6) AS p, round(p - 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n), 6) AS low, round(p + 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n), 6) AS high FROM a""")
def share_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wald interval of a share; two numbers come to the driver."""
    n, p = T.forecasts(spark, sf_dir).agg(F.count("*"), F.avg((F.col("y") == 0).cast("double"))).first()
    low, high = evaluation.wald(p, n)
    return spark.createDataFrame([(n, round(p, 6), round(low, 6), round(high, 6))], "n long, p double, low double, high double")


@query()
def simulated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The treatment simulator and its known effects by score."""
    return causal.true_effects(causal.simulate(spark, 20_000, 1), "score_diff")


GRAPH = "digraph { strength -> sub; strength -> passes; sub -> fresh; fresh -> passes }"


@query()
def adjustment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph text, its vertices, and the sets that close back doors or stand in the front door. No table is read: the graph
    is the input; tests hold the sets against a search of all paths."""
    edges = causal.edges_of(GRAPH)
    kinds = {"minimal back-door": causal.backdoor_sets, "back-door": causal.all_backdoor_sets, "front-door": causal.frontdoor_sets}
    rows = [(kind, ",".join(sorted(s))) for kind, sets in kinds.items() for s in sets(edges, "sub", "passes")]
    return spark.createDataFrame([*rows, ("vertices", ",".join(causal.vertices(GRAPH)))], "kind string, adjustment string")


@query("WITH " + T.TREATMENT + """, m AS (SELECT avg(outcome) AS my, avg(treated) AS mx, avg(covariate) AS mz, count(*) AS n FROM treatment),
s AS (SELECT sum((treated - mx) * (treated - mx)) AS xx, sum((covariate - mz) * (covariate - mz)) AS zz, sum((treated - mx) * (covariate - mz)) AS xz, sum((treated - mx) * (outcome - my)) AS xy, sum((covariate - mz) * (outcome - my)) AS zy,
  sum((outcome - my) * (outcome - my)) AS yy, any_value(n) AS n FROM treatment, m),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s),
e AS (SELECT *, sqrt((yy - b1 * xy - b2 * zy) / (n - 3) * zz / (xx * zz - xz * xz)) AS se FROM b)
SELECT 'outcome' AS outcome, 'treated' AS tested, round(b1, 4) AS estimate, round(b1 - 1.959963984540054 * se, 4) AS low, round(b1 + 1.959963984540054 * se, 4) AS high,
  b1 - 1.959963984540054 * se <= 0 AND b1 + 1.959963984540054 * se >= 0 AS independent FROM e""")
def conditional_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether treatment tells about the outcome beside the covariate."""
    r = causal.independence(T.treatment(spark, sf_dir), "outcome", "treated", ["covariate"])
    return r.select("outcome", "tested", *[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")], "independent")


def robust_sql(steps: int) -> str:
    """Steps of iteratively reweighted least squares with four degrees of freedom, one common table expression a step."""
    out = "WITH r AS (SELECT l_extendedprice / 1000 AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem), m AS (SELECT avg(y) AS my, avg(x) AS mx, var_pop(y) AS v, count(*) AS n FROM r), c AS MATERIALIZED (SELECT y - my AS y, x - mx AS x FROM r, m),\ns0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, v FROM m)"
    for k in range(steps):
        out += f""",
w{k} AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * y * y) AS syy, count(*) AS n FROM (SELECT x, y, 5 / (4 + pow(y - a - b * x, 2) / v) AS w FROM c, s{k})),
s{k + 1} AS MATERIALIZED (SELECT a, b, (syy - 2 * (a * sy + b * sxy) + a * a * sw + 2 * a * b * sx + b * b * sxx) / n AS v FROM (SELECT *, (sy - b * sx) / sw AS a FROM (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM w{k})))"""
    return out + f"""
SELECT 'intercept' AS term, round(a - b * mx + my, 5) AS estimate, round(sqrt(s{steps}.v), 5) AS scale FROM s{steps}, m UNION ALL SELECT 'quantity', round(b, 5), round(sqrt(v), 5) FROM s{steps}"""


@query(robust_sql(60))
def robust_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression with Student-t errors by iteratively reweighted aggregates."""
    rows = T.table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("quantity"))
    r = causal.robust_regression(rows, "price", ["quantity"], tolerance=1e-9)
    return r.select("term", F.round("estimate", 5).alias("estimate"), F.round("scale", 5).alias("scale"))


@query("WITH " + T.GAMES + """ SELECT match_id FROM games WHERE kick_off >= (SELECT max(kick_off) FROM games WHERE season < 2000)""")
def resumed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that resumes at the last stored day."""
    g = T.games(spark, sf_dir)
    return readers.since(g, g.where("season < 2000"), "kick_off").select("match_id")
