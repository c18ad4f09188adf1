"""Sinks: overwrite, append with de-duplication in versions, dated archives that are never overwritten, idempotent trackers, Markdown."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.ledgers import appended
from touchline.operators.relational import keep_last


def overwrite(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").options(**options).format(format).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table is there whole: Spark's writers put _SUCCESS last."""
    return exists(spark, f"{path}/_SUCCESS")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a table that replace() keeps, oldest first."""
    if not exists(spark, path):
        return []
    found = [s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path)) if s.isDirectory()]
    return sorted(n for n in found if n.startswith("version=") and finished(spark, f"{path}/{n}"))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table that replace() keeps, or None before the first."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None


def replace(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write df as the next version of a table. Readers see the version before until this one is whole, and a crash leaves that one.

    The `keep` newest versions stay, for readers that have begun; of what a crash left, the number is used again.
    """
    spark = df.sparkSession
    found = versions(spark, path)
    number = int(found[-1].partition("=")[2]) + 1 if found else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number:012d}")
    for old in found[: len(found) + 1 - keep]:
        _files(spark, path).delete(_path(spark, f"{path}/{old}"), True)


def archive(spark: SparkSession, path: str, archive_root: str, vintage: str) -> bool:
    """Copy the current table to archive_root/vintage=... before it is replaced; a whole archive stays, one that a crash left is
    written again. True if copied."""
    to = f"{archive_root}/vintage={vintage}"
    now = current(spark, path)
    if now is None and finished(spark, path):
        now = spark.read.parquet(path)
    if now is None or finished(spark, to):
        return False
    now.write.mode("overwrite").parquet(to)
    return True


def append_deduplicated(new: DataFrame, path: str, key: list[str]) -> None:
    """Append rows and keep the newest of each key, as a new version of the table."""
    old = current(new.sparkSession, path)
    replace(keep_last(new, key, [F.lit(0), *map(F.col, key)]) if old is None else appended(old, new, key), path)


def save_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """A model's bundle: its tables (draws, codes) as Parquet and its nested settings as JSON, which is written last and names the tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"tables": sorted(tables), "settings": settings})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_bundle")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and settings of a bundle."""
    found = json.loads(spark.read.text(f"{path}/_bundle").first()["value"])  # one line
    return {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}, found["settings"]


def track(df: DataFrame, path: str, day: str) -> None:
    """Write a day's rows so that a second run of the day replaces them and other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def markdown(df: DataFrame, rows: int, digits: int = 4) -> str:
    """A report table of the first rows (a report is small by intent)."""
    got = df.limit(rows).collect()
    said = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(said(x) for x in r) + " |" for r in got)])


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)
