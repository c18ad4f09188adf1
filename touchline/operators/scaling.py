"""Standardisation: variants that differ in groups, degrees of freedom and what a degenerate group gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled(rows: DataFrame, value: str, groups: list[str], name: str, degenerate: str = "zero", of: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sample deviation within a group, as column `name`; where that is null or 0: 'unit' divides by 1, 'zero' gives 0.

    A table of moments is joined, so groups may be few and hold any share of the rows: partial sums and not rows are shuffled by group, and
    Spark broadcasts the moments if they are small enough. They are those of `of` if that is given, such as the stored rows that `rows` come
    from."""
    m = (rows if of is None else of).groupBy(*groups).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    keys = [f"_k{i}" for i in range(len(groups))]
    m = m.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], "_mean", "_sd")
    same = F.lit(True)
    for g, k in zip(groups, keys, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(k))
    usable = F.col("_sd") > 0  # null counts as not usable
    z = (F.col(value) - F.col("_mean")) / F.when(usable, F.col("_sd")).otherwise(1.0)
    z = z if degenerate == "unit" else F.when(usable, z).otherwise(0.0)
    return rows.join(m, same, "left").withColumn(name, z).drop("_mean", "_sd", *keys)


def frozen_scalars(table: DataFrame, values: list[str]) -> DataFrame:
    """One mean and one deviation for each value out of moments by match day: the plain means over the days of the days' means and
    deviations."""
    return table.agg(*[F.avg(f"{v}_{n}").alias(f"{v}_{n}") for v in values for n in ("mean", "sd")])


def moments(rows: DataFrame, values: list[str], groups: list[str]) -> DataFrame:
    """Mean and sample deviation of each value by group, to be kept and applied to other rows."""
    return rows.groupBy(*groups).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def frozen(rows: DataFrame, table: DataFrame, values: list[str], day: str) -> DataFrame:
    """Apply moments by match day to new rows; days beyond the last one trained take the last; a deviation of 0 gives 0.

    The table has one row per match day of a season.
    """
    last = table.agg(F.max(day).alias("_last"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("_day", F.least(F.col(day), F.col("_last"))).drop("_last")
    joined = rows.join(table.withColumnRenamed(day, "_day"), "_day", "left")
    z = {v + "_z": F.coalesce(F.try_divide(F.col(v) - F.col(v + "_mean"), F.col(v + "_sd")), F.lit(0.0)) for v in values}
    return joined.withColumns(z).drop("_day", *[f"{v}_{n}" for v in values for n in ("mean", "sd")])


def scaler(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, both deviations, smallest and largest of a column."""
    return rows.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )


def whole(rows: DataFrame, value: str) -> DataFrame:
    """Whole-sample z-scores with either deviation, min-max and the way back; the scaler is a single row."""
    x = F.col(value)
    out = rows.crossJoin(F.broadcast(scaler(rows, value)))
    out = out.withColumns(
        {
            "z": F.try_divide(x - F.col("mean"), F.col("sd")),
            "z_pop": F.try_divide(x - F.col("mean"), F.col("sd_pop")),
            "unit": F.try_divide(x - F.col("low"), F.col("high") - F.col("low")),
        }
    )
    return out.withColumn("back", F.col("z") * F.col("sd") + F.col("mean")).drop("n", "mean", "sd", "sd_pop", "low", "high")
