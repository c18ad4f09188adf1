"""Contract checks as a table: label, PASS / WARN / FAIL, detail. Each check is one aggregate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report(label: str, ok: Column, detail: Column, frame: DataFrame, warn: bool = False) -> DataFrame:
    """One row from a one-row frame."""
    bad = "WARN" if warn else "FAIL"
    return frame.select(F.lit(label).alias("check"), F.when(ok, "PASS").otherwise(bad).alias("result"), detail.cast("string").alias("detail"))


def required_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(rows.columns))
    return rows.sparkSession.createDataFrame([("required columns", "FAIL" if missing else "PASS", ",".join(missing))], "check string, result string, detail string")


def unique_key(rows: DataFrame, key: list[str]) -> DataFrame:
    n = rows.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n"))
    return report("unique " + ",".join(key), F.col("n") == 0, F.col("n"), n)


def share_at_least(rows: DataFrame, label: str, good: Column, least: float, warn: bool = False) -> DataFrame:
    s = rows.agg(F.round(F.avg(good.cast("int")), 6).alias("s"))
    return report(label, F.coalesce(F.col("s") >= least, F.lit(False)), F.col("s"), s, warn)


def fewer_than(rows: DataFrame, label: str, bad: Column, limit: int, warn: bool = False) -> DataFrame:
    n = rows.agg(F.count_if(bad).alias("n"))
    return report(label, F.col("n") < limit, F.col("n"), n, warn)


def domain(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    return fewer_than(rows, f"domain of {column}", F.col(column).isNotNull() & ~F.col(column).isin(allowed), 1)


def with_lags(rows: DataFrame, total: str, own: str, partition: list[str], order: list[str]) -> DataFrame:
    """What the checks of running totals look at: the step of the total, the row before and whether there is none."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumns({"_d": F.col(total) - F.lag(total).over(w), "_p": F.lag(own).over(w), "_first": F.row_number().over(w) == 1})


def checks(rows: DataFrame, measures: list[tuple[str, Column, Callable[[Column], Column], bool]], group: list[str] = []) -> DataFrame:
    """Many checks by one aggregate: (label, aggregate, test of its value, whether a miss only warns), a row for each."""
    one = rows.groupBy(*group).agg(*[m.alias(f"m{k}") for k, (_, m, _, _) in enumerate(measures)])
    row = lambda k, label, ok, warn: F.struct(
        F.lit(label).alias("check"), F.when(F.coalesce(ok(F.col(f"m{k}")), F.lit(False)), "PASS").otherwise("WARN" if warn else "FAIL").alias("result"),
        F.col(f"m{k}").cast("string").alias("detail"),
    )
    each = F.explode(F.array(*[row(k, label, ok, warn) for k, (label, _, ok, warn) in enumerate(measures)]))
    return one.select(*group, each.alias("x")).select(*group, "x.*")


def step_share() -> Column:
    """Of the rows after a first one, the share whose total has grown by the goals of the row before."""
    return F.round(F.avg(F.when(~F.col("_first"), (F.col("_d") == F.col("_p")).cast("int"))), 6)


def timing(rows: DataFrame, total: str, team_total: str, share: str, own: str) -> DataFrame:
    """Rules of a table of appearances after with_lags(): totals stand as before the match, begin at 0 and give the stored share, shares above 1 and
    large counts are few."""
    later, step = ~F.col("_first"), F.col("_d")
    mean = lambda c, where: F.avg(F.when(where, c.cast("double")))
    ratio = F.try_divide(F.col(total).cast("double"), F.nullif(F.col(team_total).cast("double"), F.lit(0.0)))
    both = F.col(share).isNotNull() & ratio.isNotNull()
    one = rows.agg(
        mean(step == F.col("_p"), later).alias("pre"), mean(step == F.col(own), later).alias("post"), mean(F.col(total) == 0, F.col("_first")).alias("first"),
        mean(close(ratio, F.col(share)), both).alias("same"), F.count_if(F.col(share) > 1).alias("over"), F.max(own).alias("top"), F.avg((F.col(own) > 6).cast("double")).alias("above"),
    )
    c, text = F.col, lambda x: F.format_string("%.4f", F.col(x))
    rules = [
        ("timing: total is that before the match", (c("pre") > 0.995) & (c("pre") > c("post")), F.concat(text("pre"), F.lit(" against "), text("post")), False),
        ("timing: first appearance has 0", c("first") == 1, text("first"), False), ("timing: share is the ratio", c("same") > 0.999, text("same"), False),
        ("sanity: shares above 1", c("over") < 50, c("over"), True), ("sanity: goal counts", (c("top") <= 6) | (c("above") < 0.001), c("top"), True),
    ]
    row = lambda label, ok, detail, warn: F.struct(
        F.lit(label).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("WARN" if warn else "FAIL").alias("result"), detail.cast("string").alias("detail")
    )
    return one.select(F.explode(F.array(*[row(*r) for r in rules])).alias("x")).select("x.*")


def opening(rows: DataFrame, points: str, team: list[str], day: str) -> DataFrame:
    """Points before a team's first match have to be 0."""
    first = rows.withColumn("_o", F.min(day).over(Window.partitionBy(*team))).where(F.col(day) == F.col("_o"))
    one = first.agg(F.avg((F.col(points) == 0).cast("double")).alias("v"))
    return report("timing: points are 0 at the first match", F.col("v") == 1, F.format_string("%.4f", F.col("v")), one)


def density(rows: DataFrame, season: str, match: str, off: float) -> DataFrame:
    """Rows a match by season may differ from their median by a share `off` at most; the detail counts seasons that differ more."""
    d = rows.groupBy(season).agg((F.count("*") / F.countDistinct(match)).alias("x"))
    med = d.agg(F.percentile("x", F.lit(0.5)).alias("med"))  # a number a season
    n = d.crossJoin(F.broadcast(med)).agg(F.count_if(F.abs(F.col("x") - F.col("med")) / F.col("med") > off).alias("n"))
    return report("appearance density", F.col("n") == 0, F.col("n"), n)


def drift(rows: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Mean and number of rows by each of some groupings, one below the other: (by, value, <value>, n)."""
    one = lambda g: rows.groupBy(F.lit(g).alias("by"), F.col(g).cast("string").alias("value")).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return reduce(DataFrame.union, map(one, groups))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def fingerprint(rows: DataFrame, category: str) -> DataFrame:
    """Row count and category mix, to be compared with a stored one."""
    n = rows.groupBy(category).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def same_fingerprint(now: DataFrame, stored: DataFrame, category: str) -> DataFrame:
    b = stored.select(F.col(category).alias("_k"), F.col("share").alias("_share"))
    d = now.join(b, F.col(category).eqNullSafe(F.col("_k")), "full")
    off = d.agg(F.max(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("_share", F.lit(0.0)))).alias("d"))
    return report("category mix", F.col("d") < 1e-4, F.round("d", 6), off)


def parity(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Largest difference of a value over the joined keys of two frames."""
    d = a.join(b.select(*key, F.col(value).alias("_v")), key).agg(F.max(F.abs(F.col(value) - F.col("_v"))).alias("d"))
    return report(f"parity of {value}", F.coalesce(F.col("d") < tolerance, F.lit(False)), F.col("d"), d)


def coverage(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a vintage has gained and lost against another."""
    a, b = now.select(*key).distinct(), before.select(*key).distinct()
    gained = a.join(b, key, "left_anti").agg(F.count("*").alias("gained"))
    return gained.crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("lost")))


def audit(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, checks)
