"""Sums over rows of arrays of posterior draws: rows x draws are never spelled out.

A row holds a number for each draw, or what such numbers are made of. Tasks sum arrays element by element for each group, so that what is
shuffled is one array a group and task; the sums of a group then meet in sorted order. Memory: `room` bytes of sums, and
numbers of `cells` rows x draws at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from touchline.functions import scoring as S
from touchline.operators.relational import dealt
from touchline.sources.scratch import kept

#: What makes of some rows an array (rows, draws) for each name.
Make = Callable[[pa.RecordBatch], list[np.ndarray]]
ROOM, CELLS = 64 << 20, 1 << 20


class Sums:
    """Running sums of arrays by key."""

    def __init__(self) -> None:
        self.at: dict[tuple, list] = {}
        self.bytes = 0

    def add(self, keys: list[tuple], n: np.ndarray, arrays: list[np.ndarray]) -> None:
        known: dict[tuple, int] = {}
        code = np.array([known.setdefault(k, len(known)) for k in keys])
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        parts = [np.add.reduceat(a[order], first, axis=0) for a in (n, *arrays)]
        for i, k in enumerate(known):
            if k in self.at:
                for s, p in zip(self.at[k], parts, strict=True):
                    s += p[i]
            else:
                self.at[k] = [np.array(p[i]) for p in parts]
                self.bytes += sum(p[i].nbytes for p in parts) + 200

    def out(self, schema: pa.Schema, but: tuple | None = None) -> Iterator[pa.RecordBatch]:
        """Give the sums away, but those of one key, some at a time."""
        keep = self.at.pop(but, None) if but is not None else None
        rows = list(self.at.items())
        for i in range(0, len(rows), 1000):
            part = rows[i : i + 1000]
            keys = list(zip(*(k for k, _ in part), strict=True)) if part[0][0] else []
            columns = [*keys, [int(v[0]) for _, v in part], *[[v[j] for _, v in part] for j in range(1, len(part[0][1]))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        self.at, self.bytes = ({but: keep} if keep is not None else {}), 0


def summed(rows: DataFrame, keys: list[str], columns: list[str], names: list[str], make: Make, draws: int, room: int = ROOM, cells: int = CELLS) -> DataFrame:
    """By `keys` the number of rows and the sums of the arrays `names` that `make` takes from `columns`."""
    out = StructType([*[rows.schema[k] for k in keys], StructField("n", LongType()), *[StructField(n, ArrayType(DoubleType())) for n in names]])
    kinds = pa.schema([*[(k, arrow_type(rows.schema[k].dataType.simpleString())) for k in keys], ("n", pa.int64()), *[(n, pa.list_(pa.float64())) for n in names]])
    step = max(1, cells // max(1, draws))

    def keyed(b: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            sums.add(keyed(b), np.ones(b.num_rows), make(b))
            if sums.bytes > room:
                yield from sums.out(kinds)
        yield from sums.out(kinds)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            if b.num_rows:
                at = keyed(b)
                sums.add(at, b.column("n").to_numpy().astype(float), [matrix(b, n) for n in names])
                yield from sums.out(kinds, at[-1])  # rows come sorted: all keys but the last are whole
        yield from sums.out(kinds)

    parts = rows.select(*keys, *[c for c in columns if c not in keys]).mapInArrow(partial, out)
    parts = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)  # a row a task
    return parts.mapInArrow(merged, out)


def arrow_type(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "date": pa.date32(), "boolean": pa.bool_()}
    return known[kind]


def matrix(b: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of arrays of one length as (rows, elements)."""
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def sums_of(rows: DataFrame, keys: list[str], columns: list[str], draws: int) -> DataFrame:
    """By `keys` the number of rows and the element-wise sums of array columns."""
    return summed(rows, keys, columns, columns, lambda b: [matrix(b, c) for c in columns], draws)


def _scores(p: np.ndarray, came: np.ndarray) -> list[np.ndarray]:
    """Log loss, RPS and Brier score of probabilities (rows, draws, classes), by row and draw."""
    one = np.eye(p.shape[2])[came][:, None]
    hit = np.take_along_axis(p, came[:, None, None].repeat(p.shape[1], 1), 2)[..., 0]
    gaps = (np.cumsum(p, axis=2) - np.cumsum(one, axis=2))[..., :-1] ** 2
    return [-np.log(np.maximum(hit, 1e-12)), gaps.sum(axis=2) / (p.shape[2] - 1), ((p - one) ** 2).sum(axis=2)]


def _mean_scores(rows: DataFrame, keys: list[str], columns: list[str], make: Make, cells: int) -> DataFrame:
    names = ["log_loss", "rps", "brier"]
    got = summed(rows, keys, columns, names, make, cells)
    return got.select(*keys, "n", *[F.transform(c, lambda x: x / F.col("n")).alias(c) for c in names])


def posterior_scores(rows: DataFrame, keys: list[str], classes: int, draws: int) -> DataFrame:
    """Mean scores by draw of rows (keys, p, y): p has the class probabilities of all draws, one draw after the other, y is the class that
    came. By group arrays log_loss, rps and brier, one number a draw."""
    make = lambda b: _scores(matrix(b, "p").reshape(b.num_rows, -1, classes), b.column("y").to_numpy().astype(int))
    return _mean_scores(rows, keys, ["p", "y"], make, draws * classes)


def tilted_scores(rows: DataFrame, keys: list[str], slopes: list[float], draws: int) -> DataFrame:
    """posterior_scores of rows (keys, p, y, beta) whose class probabilities p are tilted by each draw of beta: times exp(slope * draw) by
    class, made to sum to 1 again. The tilted ones exist only inside a block of rows."""

    def make(b: pa.RecordBatch) -> list[np.ndarray]:
        p, beta, came = matrix(b, "p"), matrix(b, "beta"), b.column("y").to_numpy().astype(int)
        q = [p[:, k, None] * (np.exp(s * beta) if s else 1.0) for k, s in enumerate(slopes)]
        whole = sum(q[1:], q[0])
        loss, rps, brier = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
        upto = np.zeros_like(beta)
        for k, w in enumerate(q):  # class by class: contiguous arrays (rows, draws)
            w, one = w / whole, (came == k)[:, None]
            brier += (w - one) ** 2
            upto += w
            if k < len(q) - 1:
                rps += (upto - (came <= k)[:, None]) ** 2
            np.copyto(loss, w, where=one)
        return [-np.log(np.maximum(loss, 1e-12)), rps / (len(q) - 1), brier]

    return _mean_scores(rows, keys, ["p", "y", "beta"], make, draws)


def gathered(rows: DataFrame, key: str, spread: str, parts: int = 16) -> DataFrame:
    """Narrow rows with those of a key together, before each meets an array: tasks then hold few sums, and give few away. A key's rows are dealt
    over `parts` tasks at most by a hash of `spread`, so that no task has all of a frequent one."""
    return dealt(rows, key, F.pmod(F.hash(spread), F.lit(parts))).sortWithinPartitions(key)


def banded(column: str, name: str, low: float = 0.05, high: float = 0.95, digits: int = 6) -> list:
    """Band and mean of an array, as columns; the array is sorted inside its row."""
    s, mean = F.array_sort(column), S.total(F.col(column)) / F.size(column)
    return [F.round(x, digits).alias(f"{name}_{n}") for n, x in (("low", S.quantile(s, low)), ("mid", mean), ("up", S.quantile(s, high)))]


def against_all(by_key: DataFrame, everything: DataFrame, names: list[str]) -> DataFrame:
    """By draw, a key's mean less the mean of all rows: sums by key, and a single row of sums of everything."""
    one = everything.select(F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in names])
    less = {c: F.zip_with(c, f"_{c}", lambda a, b: a / F.col("n") - b / F.col("_n")) for c in names}
    return by_key.crossJoin(F.broadcast(one)).withColumns(less).drop("_n", *[f"_{c}" for c in names])


def boards(rows: DataFrame, key: str, beta: np.ndarray, cuts: list[float], context: list[int], pitch: int | None) -> DataFrame:
    """Expected goals above average by key and draw, arrays `par` and `sar`.

    Rows are (key, effect, x): a player, the player's effect by draw and the factors of an appearance, standardised; beta is the matrix
    (draws, factors). `par` takes the factors as they were. `sar` takes them as they would be for everybody alike: those of the
    `context` are 0, their average, and the home pitch is its mean. Goals are 0 to the number of cut points, by ordered logit. A block
    of rows is multiplied with all draws at once and only sums by player and draw are kept.
    """
    draws = len(beta)
    mean = (rows.agg(F.avg(F.col("x")[pitch])).first()[0] or 0.0) if pitch is not None else 0.0

    def goals(eta: np.ndarray) -> np.ndarray:
        out = np.zeros_like(eta)
        for c in cuts:  # the mean of a count is the sum of the probabilities that it exceeds 0, 1, ...
            out += 1 / (1 + np.exp(c - eta))
        return out

    def make(b: pa.RecordBatch) -> list[np.ndarray]:
        x, effect = matrix(b, "x"), matrix(b, "effect")
        level = x.copy()
        level[:, context] = 0.0
        if pitch is not None:
            level[:, pitch] = mean
        return [goals(effect + x @ beta.T), goals(effect + level @ beta.T)]

    by = kept(summed(rows, [key], ["effect", "x"], ["par", "sar"], make, draws))
    counted = by.select(F.array(F.col("n").cast("double")).alias("rows"), "par", "sar")
    whole = sums_of(counted, [], ["rows", "par", "sar"], draws).select(F.col("rows")[0].alias("n"), "par", "sar")
    return against_all(by, whole, ["par", "sar"])
