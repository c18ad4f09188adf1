"""Durable cuts of a lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="touchline-core-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without it a session of one process (tests) gets a temporary one; a cluster must name one."""
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if path is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or _own()


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read back: what follows reads it as often as it likes, and a lost executor does not bring it down."""
    path = f"{folder(df.sparkSession)}/touchline-core/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
