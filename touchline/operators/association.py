"""Correlations of many columns at once, with gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from touchline.operators import draws as D

#: Sums over the rows in which both of two columns have a value.
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _moments(groups: list[str], schema: pa.Schema, k: int, shift: np.ndarray, rows: int):
    """Rows (groups, x) -> for each group and column the sums with all other columns, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for g, s in sums.items():
                columns = [*[[v] * k for v in g], list(range(k)), *[list(m) for m in s]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            sums.clear()

        for b in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
            keys = list(zip(*(b.column(g).to_pylist() for g in groups), strict=True)) if groups else [()] * b.num_rows
            x = D.matrix(b, "x") - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            known: dict[tuple, int] = {}
            code = np.array([known.setdefault(g, len(known)) for g in keys])
            for g, i in known.items():
                at = code == i
                u, v = x[at], m[at]
                part = np.stack([v.T @ v, u.T @ v, v.T @ u, (u * u).T @ v, v.T @ (u * u), u.T @ u])
                sums[g] = sums[g] + part if g in sums else part
                if len(sums) * part.nbytes > D.ROOM:  # of many groups some go on early
                    yield from given()
        yield from given()

    return run


def correlations(rows: DataFrame, columns: list[str] | str, groups: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """Pearson's correlation of each two columns over the rows that have both: (groups, i, j, n, corr) with i < j, their places.

    `columns` are names, or the name of one array column of a fixed length. One scan sums masked products, a matrix a group and
    task; rows are never repeated for pairs. Values are taken from a point near the first rows' means, so that sums of squares keep their digits. NaN
    counts as a gap; a pair without two rows or without spread has a null.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns]) if isinstance(columns, list) else F.transform(columns, lambda v: v.cast("double"))
    data = rows.select(*groups, x.alias("x"))
    head = [r["x"] for r in data.select("x").where(F.col("x").isNotNull()).limit(1000).collect()]
    if not head:
        kinds = StructType([*[rows.schema[g] for g in groups], StructField("i", LongType()), StructField("j", LongType()), StructField("n", LongType()), StructField("corr", DoubleType())])
        return rows.sparkSession.createDataFrame([], kinds)
    first = np.array(head, float)
    known = np.isfinite(first)
    shift = np.where(known, first, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    k = len(shift)
    out = StructType([*[rows.schema[g] for g in groups], StructField("i", LongType()), *[StructField(m, ArrayType(DoubleType())) for m in MOMENTS]])
    kinds = pa.schema([*[(g, D.arrow_type(rows.schema[g].dataType.simpleString())) for g in groups], ("i", pa.int64()), *[(m, pa.list_(pa.float64())) for m in MOMENTS]])
    parts = data.where(F.col("x").isNotNull()).mapInArrow(_moments(list(groups), kinds, k, shift, block), out).withColumnRenamed("n", "both")
    by = D.sums_of(parts, [*groups, "i"], ["both", *MOMENTS[1:]], k)
    each = F.posexplode(F.arrays_zip("both", *MOMENTS[1:])).alias("j", "s")
    pairs = by.select(*groups, "i", each).where("j > i").select(*groups, "i", F.col("j").cast("long").alias("j"), "s.*")
    n, c = F.col("both"), F.col
    cov = c("sxy") - c("sx") * c("sy") / n
    vx, vy = c("sxx") - c("sx") ** 2 / n, c("syy") - c("sy") ** 2 / n
    spread = (n >= 2) & (vx > 1e-12 * c("sxx")) & (vy > 1e-12 * c("syy"))
    return pairs.select(*groups, "i", "j", n.cast("long").alias("n"), F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).alias("corr"))


def top_pair(pairs: DataFrame, *groups: str) -> DataFrame:
    """The pair of the largest absolute correlation by group; ties take the first columns."""
    order = F.struct(F.abs("corr").alias("a"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "corr", "n")
    best = pairs.where(F.col("corr").isNotNull()).groupBy(*groups).agg(F.max(order).alias("m"))
    return best.select(*groups, (-F.col("m.i")).alias("i"), (-F.col("m.j")).alias("j"), F.col("m.n").alias("n"), F.col("m.corr").alias("corr"))
