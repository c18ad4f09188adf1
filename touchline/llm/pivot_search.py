"""Exact top-k search by inner product in a pivot-distance index.

Vectors become whole numbers, floor(256 * x). To search the largest inner product as the smallest distance, each vector gets one more
component that brings it onto the sphere whose radius M is the largest norm; a query is scaled onto that sphere too. There
|q - x|^2 = 2 M^2 - 2 s (q . x) with the query's scale s, so a score is a distance.

* Index. A vector belongs to its nearest pivot; pivots are centres of a bounded sample (`Settings.sample` rows). Its key is the pivot and
  the number of its annulus, distance // width. All rows are sorted by (pivot, annulus, distance, id) and written as blocks of at most
  `Settings.block` rows of one annulus. Equal vectors share a key, so keys are dealt out by ranges that include the id, and their
  blocks are many.
* First expansion. A query starts with the k-th best score among the sample, then reads the annuli around its own distance from its
  `Settings.home` nearest pivots.
* Second expansion. With k-th best score t, no vector outside the distance R = sqrt(2 M^2 - 2 s t) matters; by the triangle inequality a
  vector in it lies in an annulus between d - R and d + R about each pivot at distance d from the query. Exactly these annuli are
  looked up by key, and of their blocks those whose range of distances overlaps (for ties: that hold a smaller id). Annuli outside are
  never read. The bounds carry a margin above rounding errors, scores are whole numbers: the result is exact.

A block meets its queries in lanes of at most about `Settings.lane` queries, which stream past it; what they find above their threshold
is at most k rows for each block. Queries are a stated set against all rows, in blocks.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part. A missing component at the end counts as 0, so
vectors of any length have a score; an empty vector scores 0. A zero query scores 0 with all and gets the smallest ids. Repeated rows
and ids are rows of their own; a query leaves out its own row only. With fewer candidates than k, all are returned. Numbers are taken
up to 2^53 and scores up to the range of a long; beyond, the nearest one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import settle

LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: int = 256
    every: int = 50  #: ids divisible by it are queries
    sample: int = 4096  #: rows, at most, that pivots and widths are fitted to
    pivots: int = 256  #: at most
    home: int = 3  #: nearest pivots whose annuli are read first
    annuli: int = 24  #: of a pivot, about, at most
    block: int = 2048  #: rows, at most; pivots and annuli are as many as give blocks half as large
    lane: int = 4096  #: queries
    seed: int = 13


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of any length as rows of float64, filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    out[np.arange(width) < pc.list_value_length(column).to_numpy(zero_copy_only=False)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64: by floats while these are exact, else by integers of any size."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    if top < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    a, b = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
    out = [[min(max(int(v), LEAST), MOST) for v in row] for row in a @ b.T]
    return np.array(out, np.int64).reshape(len(q), len(x))


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """Vectors with the component that brings them onto the sphere."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, radius**2 - (x * x).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], ~score[some]))][:k]  # ~ reverses the order without an overflow


@dataclass(frozen=True)
class Fit:
    """What the index is fitted to: its size is bounded by the settings and a vector's length."""

    length: int  #: components of the longest vector
    radius: float
    pivots: np.ndarray
    width: float
    rows: np.ndarray  #: of the sample: row numbers, ids and vectors
    ids: np.ndarray
    vectors: np.ndarray

    @property
    def margin(self) -> float:
        """Above the rounding error of a distance."""
        return 1e-5 * self.radius + 1e-9


def centres(x: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centres of clusters: distinct rows as first centres, then means."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]]
    for _ in range(rounds):
        at = distances(x, c).argmin(axis=1)
        n_at = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], c)
    return c


def fitted(rows: DataFrame, settings: Settings) -> Fit | None:
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, length, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return None
    part = rows if n <= settings.sample else rows.where(F.pmod(F.xxhash64("row", F.lit(settings.seed)), F.lit(1 << 30)) < int(settings.sample / n * (1 << 30)))
    got = part.limit(2 * settings.sample).toArrow()  # a row goes in or not by a hash: about `sample` rows, twice as many at most
    width = max(1, length)
    x = matrix(got.column("v"), width)
    radius = float(np.sqrt(most))
    up = lifted(x, radius)
    keys = 1 + 2 * n // settings.block
    pivots = centres(up, min(settings.pivots, int(2 * keys**0.5)), settings.seed) if len(up) else np.zeros((1, width + 1))
    near = distances(up, pivots).min(axis=1) if len(up) else np.zeros(1)
    low, high = np.quantile(near, [0.01, 0.99])
    return Fit(width, radius, pivots, max(float(high - low) / min(settings.annuli, -(-keys // len(pivots))), 1e-6 * radius, 1e-9), got.column("row").to_numpy(), got.column("vec_id").to_numpy(), x)


PLACED = "row long, vec_id long, v array<double>, pivot int, annulus int, d double"


def _placed(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(lifted(matrix(b.column("v"), fit.length), fit.radius), fit.pivots)
            at = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            near = d[np.arange(len(d)), at]
            columns = [*b.columns, pa.array(at.astype(np.int32)), pa.array((near // fit.width).astype(np.int32)), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "pivot", "annulus", "d"])

    return run


BLOCKS = "block long, pivot int, annulus int, low double, high double, least long, row binary, id binary, x binary"


def _blocks(fit: Fit, size: int):
    """Rows in order of (pivot, annulus, d, vec_id) -> blocks of one annulus."""

    names = ["block", "pivot", "annulus", "low", "high", "least", "row", "id", "x"]

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        row, ids, d = (b.column(c).to_numpy() for c in ("row", "vec_id", "d"))
        shape = [pa.array(row[:1]), b.column("pivot")[:1], b.column("annulus")[:1], pa.array(d[:1]), pa.array(d[-1:]), pa.array([ids.min()])]
        data = [pa.array([x.tobytes()], pa.binary()) for x in (row, ids, matrix(b.column("v"), fit.length))]
        return pa.RecordBatch.from_arrays(shape + data, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            b = b if held is None else pa.concat_batches([held, b])
            key = b.column("pivot").to_numpy().astype(np.int64) << 32 | b.column("annulus").to_numpy()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            start = 0
            for end in ends:
                while end - start > size or end - start and end < len(key):
                    yield block(b.slice(start, min(size, end - start)))
                    start += min(size, end - start)
            held = b.slice(start)
        if held is not None and held.num_rows:
            yield block(held)

    return run


def index(rows: DataFrame, fit: Fit, settings: Settings) -> DataFrame:
    """All rows as blocks; a block is named by the number of its first row."""
    order = ["pivot", "annulus", "d", "vec_id", "row"]
    placed = rows.mapInArrow(_placed(fit), PLACED).repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.mapInArrow(_blocks(fit, settings.block), BLOCKS))


STARTS = "row long, pivot int, d double, home boolean, s double, at_least long, at_most long"


def _starts(fit: Fit, settings: Settings):
    """Queries -> a row for each pivot: the distance, whether it is one of the nearest, the query's scale, and the k-th best of the
    sample, score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (rows.slice(i, 256) for rows in batches for i in range(0, rows.num_rows, 256)):
            x, own = matrix(b.column("v"), fit.length), b.column("row").to_numpy()
            norm = np.sqrt((x * x).sum(axis=1))
            s = np.divide(fit.radius, norm, out=np.zeros(len(x)), where=norm > 0)
            d = distances(np.column_stack([x * s[:, None], np.where(norm > 0, 0.0, fit.radius)]), fit.pivots)
            near = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) < settings.home
            found = scores(x, fit.vectors)
            least, most = np.full(len(x), LEAST), np.full(len(x), MOST)
            for i, f in enumerate(found):
                other = fit.rows != own[i]
                top = best(f[other], fit.ids[other], settings.k)
                if len(top) == settings.k:
                    least[i], most[i] = f[other][top[-1]], fit.ids[other][top[-1]]
            n = len(fit.pivots)
            columns = [np.repeat(own, n), np.tile(np.arange(n, dtype=np.int32), len(x)), d.ravel(), near.ravel(), np.repeat(s, n), np.repeat(least, n), np.repeat(most, n)]
            names = [c.split()[0] for c in STARTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


FOUND = "query long, row long, vec_id long, score long"


def _met(length: int, k: int):
    """Rows of one (block, lane), the block's before its queries' -> the k best rows of the block for each query that reach its threshold."""
    schema = pa.schema([(c, pa.int64()) for c in ("query", "row", "vec_id", "score")])

    def met(part: pa.RecordBatch, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        own, least, most = (part.column(c).to_numpy() for c in ("query", "at_least", "at_most"))
        found = scores(matrix(part.column("v"), length), x)
        fine = ((found > least[:, None]) | (found == least[:, None]) & (ids <= most[:, None])) & (rows != own[:, None])
        for i in np.flatnonzero(fine.any(axis=1)):
            some = np.flatnonzero(fine[i])
            top = some[best(found[i, some], ids[some], k)]
            yield np.full(len(top), own[i]), rows[top], ids[top], found[i, top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple = ()
        for b in batches:
            kind, out, start = b.column("kind").to_numpy(), [], 0
            while start < len(kind):
                if kind[start] == 0:
                    rows, ids = (np.frombuffer(b.column(c)[start].as_py(), np.int64) for c in ("rows", "id"))
                    block = rows, ids, np.frombuffer(b.column("x")[start].as_py(), np.float64).reshape(len(rows), length)
                    start += 1
                    continue
                later = np.flatnonzero(kind[start : start + 512] == 0)
                end = start + int(later[0]) if len(later) else min(start + 512, len(kind))
                out += met(b.slice(start, end - start), *block)
                start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], schema=schema)

    return run


def _meet(wanted: DataFrame, blocks: DataFrame, queries: DataFrame, fit: Fit, settings: Settings) -> DataFrame:
    """wanted(query, block, at_least, at_most): what the blocks hold for the queries."""
    lanes = max(1, -(-queries.count() // settings.lane))
    wanted = wanted.withColumn("lane", F.pmod(F.xxhash64("query"), F.lit(lanes)).cast("int"))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("rows", "binary"), ("id", "binary"), ("x", "binary"), ("query", "long"), ("v", "array<double>"), ("at_least", "long"), ("at_most", "long"))}
    columns = lambda **given: [given.get(c, e) for c, e in empty.items()]
    held = wanted.select("block", "lane").distinct().join(blocks.withColumnRenamed("row", "rows"), "block")
    held = held.select("block", "lane", F.lit(0).alias("kind"), *columns(rows=F.col("rows"), id=F.col("id"), x=F.col("x")))
    asked = wanted.join(queries.select(F.col("row").alias("query"), "v"), "query")
    asked = asked.select("block", "lane", F.lit(1).alias("kind"), *columns(query=F.col("query"), v=F.col("v"), at_least=F.col("at_least"), at_most=F.col("at_most")))
    both = held.union(asked).repartition("block", "lane").sortWithinPartitions("block", "lane", "kind")
    return settle(both.mapInArrow(_met(fit.length, settings.k), FOUND))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbers(vectors: DataFrame, settings: Settings) -> DataFrame:
    """(row, vec_id, v) of the rows that take part: numbered, as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(1 << 53)
    v = F.transform(x, lambda c: F.least(F.greatest(c, F.lit(-most)), F.lit(most)))  # then floor() is in the range of a long
    v = F.transform(v, lambda c: F.least(F.greatest(F.floor(c * settings.scale).cast("double"), F.lit(-most)), F.lit(most)))
    return settle(vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` the k rows of the highest scores."""
    rows = numbers(vectors, settings)
    fit = fitted(rows, settings)
    if fit is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    blocks = index(rows, fit, settings)
    shape = blocks.select("block", "pivot", "annulus", "low", "high", "least")
    queries = rows.where(F.pmod("vec_id", F.lit(settings.every)) == 0)
    starts = settle(queries.mapInArrow(_starts(fit, settings), STARTS).withColumnRenamed("row", "query"))

    here = F.floor(F.col("d") / fit.width).cast("int")
    home = starts.where("home").withColumn("annulus", F.explode(F.sequence(F.greatest(here - 1, F.lit(0)), here + 1)))
    first = _meet(home.join(shape, ["pivot", "annulus"]).select("query", "block", "at_least", "at_most"), blocks, queries, fit, settings)

    ranked = _first(first, settings.k).where(F.col("rank") == settings.k)
    kth = ranked.select("query", F.col("score").alias("new_least"), F.col("vec_id").alias("new_most"))  # at least as good as the sample's
    now = starts.join(kth, "query", "left").withColumn("at_least", F.coalesce("new_least", "at_least")).withColumn("at_most", F.coalesce("new_most", "at_most"))
    room = F.lit(2 * fit.radius**2) - 2 * F.col("s") * F.col("at_least").cast("double")
    reach = F.when(F.col("at_least") == LEAST, F.lit(3 * fit.radius)).otherwise(F.sqrt(F.greatest(room, F.lit(0.0)) + F.lit(fit.margin * fit.radius))) + fit.margin
    ends = shape.groupBy("pivot").agg(F.min("annulus").alias("from"), F.max("annulus").alias("to"))  # a row for each pivot
    now = now.withColumn("reach", reach).join(F.broadcast(ends), "pivot")
    ring = lambda d: F.floor(F.greatest(d, F.lit(0.0)) / fit.width).cast("int")
    now = now.withColumn("from", F.greatest("from", ring(F.col("d") - F.col("reach")))).withColumn("to", F.least("to", ring(F.col("d") + F.col("reach"))))
    wide = now.where(F.col("from") <= F.col("to")).withColumn("annulus", F.explode(F.sequence("from", "to")))
    read_before = F.col("home") & F.col("annulus").between(here - 1, here + 1)
    zero = (F.col("s") == 0) & (F.col("at_least") == 0) & (F.col("least") > F.col("at_most"))  # a zero query: only smaller ids count
    near = (F.col("high") >= F.col("d") - F.col("reach")) & (F.col("low") <= F.col("d") + F.col("reach")) & ~zero
    second = _meet(wide.where(~read_before).join(shape, ["pivot", "annulus"]).where(near).select("query", "block", "at_least", "at_most"), blocks, queries, fit, settings)

    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    done = _first(first.union(second), settings.k).join(names, "query")
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
