"""A table whose batches rewrite only the partitions that they touch.

The files of a partition (all rows of one value of the keys, such as a league and season) lie in a folder of their own that is never
changed. A manifest names the folder of each partition; a merge writes new folders for the touched partitions and then one new
manifest, which takes its place by a rename that fails if somebody else's is there. Readers that began with an older manifest go on reading its folders.
A crash before the rename leaves the old table, one after it the new one. A manifest has a row for each partition, and a merge
collects the touched ones: as many as the table has leagues and seasons, not rows.

    path/manifest/000000000007.json       the table's eighth version
    path/parts/000000000007-1f.../part=3  a partition that it rewrote
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a merge makes of the old rows of the touched partitions (None before the first) and the batch.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    number: int
    keys: list[str]
    schema: str  #: JSON
    parts: dict[str, str]  #: JSON list of key values -> folder, relative to the table
    batches: dict[str, int]  #: the last batch of each stream that writes here

    def folders(self, path: str, values: list[str] | None = None) -> list[str]:
        return [f"{path}/{f}" for v, f in sorted(self.parts.items()) if values is None or v in values]


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a number."""
    found = [n for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]
    if number is not None:
        found = [n for n in found if int(n[:-5]) == number]
    if not found:
        return None
    text = spark.read.text(f"{path}/manifest/{found[-1]}", wholetext=True).first()["value"]
    return Manifest(**json.loads(text))


def _publish(spark: SparkSession, path: str, m: Manifest) -> None:
    """Write the manifest beside its place, then rename it: the rename is one step and never replaces another manifest."""
    jvm = spark._jvm
    source, fs = _hadoop(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(source)
    out.write(bytearray(json.dumps(m.__dict__).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{m.number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    if fs.exists(target):
        fs.delete(source, False)
        raise Conflict(f"version {m.number} of {path} is there already")
    try:
        context.rename(source, target, never)
    except Exception as e:
        fs.delete(source, False)
        if fs.exists(target):
            raise Conflict(f"version {m.number} of {path} is there already") from e
        raise


def read(spark: SparkSession, path: str, values: list[str] | None = None, number: int | None = None) -> DataFrame | None:
    """The table, or some of its partitions, as the newest manifest (or that of a number) has it; None before the first."""
    m = manifest(spark, path, number)
    if m is None:
        return None
    schema, folders = StructType.fromJson(json.loads(m.schema)), m.folders(path, values)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(batch: DataFrame, path: str, keys: list[str], how: Merge, stream: tuple[str, int] | None = None, keep: int = 2) -> list[str]:
    """Merge a batch and return the partitions that were rewritten, each as the JSON list of its key values.

    `how` sees the touched partitions only; rows that it returns for others are an error of its own and are left out. `stream` names the
    stream and its batch: one that has been merged is not merged again. The `keep` newest versions stay readable. Key values may be
    null; they have to be of types that JSON knows, or dates.
    """
    spark = batch.sparkSession
    old = manifest(spark, path)
    if stream is not None and old is not None and old.batches.get(stream[0], -1) >= stream[1]:
        return []
    touched = batch.select(*keys).distinct().collect()  # a row a partition
    if not touched:
        return []
    named = [json.dumps([v if isinstance(v, str | int | float | bool) or v is None else str(v) for v in row]) for row in touched]
    number = old.number + 1 if old else 0
    now = how(read(spark, path, named) if old else None, batch)
    codes = spark.createDataFrame([(*row, i) for i, row in enumerate(touched)], batch.select(*keys, F.lit(0).alias("part")).schema)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    coded = now.alias("n").join(F.broadcast(codes.alias("c")), on).select("n.*", "c.part")
    to = f"parts/{number:012d}-{uuid.uuid4().hex[:12]}"
    coded.repartition("part").write.partitionBy("part").parquet(f"{path}/{to}")
    written = {int(n.partition("=")[2]) for n in _names(spark, f"{path}/{to}") if n.startswith("part=")}
    parts = dict(old.parts) if old else {}
    for i, name in enumerate(named):
        if i in written:
            parts[name] = f"{to}/part={i}"
        else:
            parts.pop(name, None)  # the merge has left none of its rows
    batches = dict(old.batches) if old else {}
    if stream is not None:
        batches[stream[0]] = stream[1]
    _publish(spark, path, Manifest(number, keys, json.dumps(now.schema.jsonValue()), parts, batches))
    sweep(spark, path, keep)
    return sorted(named)


def sweep(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete manifests but the newest, and folders that none of the kept ones names and no later version can be writing."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]
    used: set[str] = set()
    for n in numbers[-keep:]:
        used |= {f.split("/")[1] + "/" + f.split("/")[2] for f in manifest(spark, path, n).parts.values()}
    newest = numbers[-1] if numbers else -1
    for version in _names(spark, f"{path}/parts"):
        if int(version.partition("-")[0]) > newest:
            continue  # of a writer that is at work
        folders = [n for n in _names(spark, f"{path}/parts/{version}") if n.startswith("part=")]
        for f in folders if any(f"{version}/{f}" in used for f in folders) else [""]:
            if f"{version}/{f}" not in used:
                p, fs = _hadoop(spark, f"{path}/parts/{version}/{f}".rstrip("/"))
                fs.delete(p, True)
    for n in numbers[:-keep]:
        p, fs = _hadoop(spark, f"{path}/manifest/{n:012d}.json")
        fs.delete(p, False)
