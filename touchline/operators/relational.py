"""Joins, de-duplication, summaries and set operations with the edge rules that the analyses need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by a total order."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def both_sides(rows: DataFrame, match: str) -> DataFrame:
    """Rows of matches that have more than one row."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(match))).where("_n > 1").drop("_n")


def mirrored(rows: DataFrame) -> DataFrame:
    """Add the missing perspective of matches seen from one side only: teams and goals swap, differences change sign."""
    lone = rows.withColumn("_n", F.count("*").over(Window.partitionBy("match_id"))).where("_n = 1").drop("_n")
    swap = {"team": "opp", "opp": "team", "gf": "ga", "ga": "gf"}
    other = lone.select(
        *[
            (1 - F.col(c) if c == "home_pitch" else -F.col(c) if c.endswith("_diff") else F.col(swap.get(c, c))).alias(c)
            for c in rows.columns
        ]
    )
    return rows.unionByName(other)


def dealt(rows: DataFrame, *key: Column | str) -> DataFrame:
    """Rows dealt out over all shuffle partitions, for narrow rows before work that takes far longer than moving them: a draw, a grid or
    many logarithms for each. Few files, or one, otherwise mean few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def ranged(rows: DataFrame, order: str, name: str = "_part") -> DataFrame:
    """Number the value ranges that a numeric column falls into, as many as there are shuffle partitions, about equally filled."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("_cuts"))
    return rows.crossJoin(F.broadcast(cuts)).withColumn(name, F.size(F.filter("_cuts", lambda q: q < F.col(order)))).drop("_cuts")


def running(rows: DataFrame, order: str, values: list[str], totals: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of values by a numeric order (inside groups), as columns <value>_sum: windows inside ranges, plus the sums of the
    ranges below (one row per range and group), so that no task sees all rows. With totals also <value>_all."""
    r = ranged(rows, order)
    sums = r.groupBy(*groups, "_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    below = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *groups, "_part", *[F.coalesce(F.sum(f"_{v}").over(below), F.lit(0)).alias(f"_{v}_below") for v in values],
        *[F.sum(f"_{v}").over(Window.partitionBy(*groups)).alias(f"{v}_all") for v in values],
    )
    w = Window.partitionBy(*groups, "_part").orderBy(order)
    out = r.withColumns({f"{v}_sum": F.sum(v).over(w) for v in values}).join(sums if groups else F.broadcast(sums), [*groups, "_part"])
    out = out.withColumns({f"{v}_sum": F.col(f"{v}_sum") + F.col(f"_{v}_below") for v in values})
    return out.drop("_part", *[f"_{v}_below" for v in values], *([] if totals else [f"{v}_all" for v in values]))


def quantiles(rows: DataFrame, value: str, shares: list[float], groups: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """Exact quantiles, linear between neighbours, as columns q0, q1, ... by group: ranks are picked from running counts by distinct
    value, so no buffer holds the values of a group. A row counts once, or as often as its column `times` says."""
    n = F.count("*") if times is None else F.sum(times)
    by = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("_c"))
    by = running(by, value, ["_c"], totals=True, groups=groups)
    here = lambda k: F.when((F.col("_c_sum") - F.col("_c") <= k) & (k < F.col("_c_sum")), F.col(value).cast("double"))
    at = [F.lit(q) * (F.col("_c_all") - 1) for q in shares]
    ends = [F.struct(F.max(here(F.floor(x))).alias("low"), F.max(here(F.ceil(x))).alias("high"), F.max(x - F.floor(x)).alias("part")).alias(f"q{i}") for i, x in enumerate(at)]
    got = by.groupBy(*groups).agg(*ends)
    q = lambda i: F.col(f"q{i}.low") + (F.col(f"q{i}.high") - F.col(f"q{i}.low")) * F.col(f"q{i}.part")
    return got.select(*groups, *[q(i).alias(f"q{i}") for i in range(len(shares))])


def nearest(treated: DataFrame, control: DataFrame, score: str) -> DataFrame:
    """For each treated (id, score) the control with the nearest score, with replacement; ties take the lower score, then id.

    Both sides are put in one order by score and split into ranges; as-of windows run inside a range, and the last and first
    control of the ranges next to it (one row per range) complete them, so no task sees all rows.
    """
    t = treated.select("id", score, F.lit(None).cast("long").alias("c"))
    both = t.unionByName(control.select(F.lit(None).cast("long").alias("id"), score, F.col("id").alias("c")))
    both = ranged(both, score, "part")
    ends = both.where("c is not null").groupBy("part").agg(
        F.max(F.struct(score, (-F.col("c")).alias("k"))).alias("top"), F.min(F.struct(score, F.col("c").alias("k"))).alias("bottom")
    )
    edge = Window.orderBy("part")
    frame = both.select("part").distinct().join(ends, "part", "left")  # one row per range
    frame = frame.select(
        "part", F.last("top", True).over(edge.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
        F.first("bottom", True).over(edge.rowsBetween(1, Window.unboundedFollowing)).alias("below"),
    )
    w = Window.partitionBy("part").orderBy(score)
    here = F.when(F.col("c").isNotNull(), F.struct(score, F.col("c").alias("k")))
    low = F.when(F.col("c").isNotNull(), F.struct(score, (-F.col("c")).alias("k")))
    left = F.max(low).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(here).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumns({"left": left, "right": right}).where("id is not null").join(F.broadcast(frame), "part")
    found = found.withColumns({"l": F.coalesce("left", "above"), "r": F.coalesce("right", "below")})
    gap_l, gap_r = F.col(score) - F.col(f"l.{score}"), F.col(f"r.{score}") - F.col(score)
    use_left = F.col("l").isNotNull() & (F.col("r").isNull() | (gap_l <= gap_r))
    return found.select(
        "id", F.when(use_left, -F.col("l.k")).otherwise(F.col("r.k")).alias("control"), F.when(use_left, gap_l).otherwise(gap_r).alias("gap")
    )


def mode(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The most frequent value by group; ties take the smallest."""
    n = rows.groupBy(*groups, value).count()
    best = F.min_by(value, F.struct(-F.col("count"), F.col(value)))
    return n.groupBy(*groups).agg(best.alias(value), F.max("count").alias("n"))


def frequencies(rows: DataFrame, value: str) -> DataFrame:
    """Counts, shares and running shares by a numeric value."""
    n = running(rows.groupBy(value).agg(F.count("*").alias("n")), value, ["n"], totals=True)
    return n.select(value, "n", (F.col("n") / F.col("n_all")).alias("share"), (F.col("n_sum") / F.col("n_all")).alias("running"))


def moments_corrected(value: str) -> list[Column]:
    """Mean, sample deviation, and skewness and excess kurtosis with the small-sample correction."""
    n = F.count(value)
    g1, g2 = F.skewness(value), F.kurtosis(value)
    return [
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurt"),
    ]


def histogram(rows: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Shares of half-open bins (low, high]; values outside give no bin, empty bins null."""
    at = F.ceil((F.col(value) - low) / width).cast("int")
    got = rows.select(at.alias("bin")).where((F.col("bin") >= 1) & (F.col("bin") <= bins)).groupBy("bin").agg(F.count("*").alias("n"))
    got = got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(got.select("bin", "share"), "bin", "left")
