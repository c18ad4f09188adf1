"""Shared pieces of the training-data operators: durable cuts of the lineage, connected components,
bounded training samples and the byte-level pre-tokeniser."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a cache of a Python worker takes, about, before it starts afresh; results do not depend on it.
CACHE_BYTES = 48 << 20
#: Bytes of text that a task takes out of Arrow at once, or one document.
TEXT_BYTES = 8 << 20


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="touchline-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a session of one process (tests) gets a temporary folder; a cluster has no folder to share and must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def modest(spark: SparkSession) -> None:
    """Let no more than some MB of rows, or one, go to a Python worker at once: with whole texts the default number of rows makes
    batches that the executor holds several times over, outside its heap. Smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = re.fullmatch(r"(\d+)\s*([kmg]?)i?b?", (spark.conf.get(key) or "").strip().lower())
        if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= most:
            spark.conf.set(key, str(most))


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps survive lost executors and never recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline/{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete the tables that settle() has written; to be called once results that were derived from them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/touchline")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that settle() has written, once nothing that is still to run reads them."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a job go when it is done (from Spark 4.1 on), not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Members:
    """A bitmap of 2**bits slots, a fixed size, that marks every id of `ids` and few others.

    It spares large rows a shuffle; an exact join of what passes must follow. Where it fills up, more rows pass and nothing else
    changes.
    """

    def __init__(self, ids: DataFrame, column: str, bits: int = 24):
        self.bits = bits
        slot = self.slot(column)
        taken = ids.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), slot.bitwiseAND(63).cast("int").alias("n"))
        got = taken.groupBy("word").agg(F.expr("bit_or(shiftleft(one, n))").alias("bit")).toArrow()  # at most 2**(bits - 6) rows
        self.words = np.zeros(1 << (bits - 6), np.int64)
        self.words[got.column("word").to_numpy()] = got.column("bit").to_numpy()

    def slot(self, column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << self.bits))

    def test(self):
        """A function of an array of slots, to be used inside tasks."""
        words = self.words
        return lambda at: words[at >> 6] >> (at & 63) & 1 == 1

    def has(self, column: str):
        """The test as a column, false for null."""
        test = self.test()

        @F.pandas_udf("boolean")
        def marked(s: pd.Series) -> pd.Series:
            return pd.Series(test(s.to_numpy(np.int64)))

        return F.col(column).isNotNull() & marked(self.slot(column))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(u, v) by alternating large-star and small-star steps: rows (node, label), label the smallest node.

    Every step is a min-aggregate and an equi-join on the node; no component is ever collected. Self-links and nulls are
    ignored; nodes without links do not appear.
    """
    edges = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select("v", "v").distinct()
            )
        before = now


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, rows: int) -> DataFrame:
    """At most `rows` labelled training documents (doc_id, text, y), the first by a hash of doc_id.

    Rows whose crc32(doc_id as text) mod `modulus` is `held` never take part. A document labelled twice counts with the larger
    label, a doc_id with several texts with the one of the smallest hash; null ids, null labels and rows without a document drop
    out. Only ids (bounded by `rows`) are broadcast.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    y = y.where(remainder("doc_id", modulus) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(y), "doc_id").withColumn("n", F.xxhash64("text"))
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct("n", "text")).alias("t"))
    return one.select("doc_id", "y", "t.text")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


class WordCache(dict):
    """word -> make(word), worked out on first sight; read with map(cache.__getitem__, words). Beyond `room` bytes it starts afresh."""

    def __init__(self, make: Callable, room: float = CACHE_BYTES):
        super().__init__()
        self.make, self.room, self.left = make, room, room

    def __missing__(self, word):
        self.left -= sys.getsizeof(word) + 136  # a slot and a number
        if self.left < 0:
            self.clear()
            self.left = self.room
        value = self[word] = self.make(word)
        return value


def slices(batch: pa.RecordBatch, column: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows, each of about `most` bytes of text or of one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(i, j - i)


def regrouped(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes of text or of one row: small ones joined, large ones cut."""
    held, size = [], 0
    for b in batches:
        for part in slices(b, column, most):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Return freed memory of a Python worker, which outlives its task, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_text(step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], most: int = TEXT_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: `step()` makes, once a task, a function of batches, which gets about `most` bytes of text at a time.

    What it holds ends with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = step()
        try:
            for b in batches:
                for part in slices(b, most=most):
                    yield of(part)
        finally:
            del of
            give_back()

    return run


# Latin letters and numbers below U+0250, spelled out so that the standard library's pattern engine can split common texts.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
COMMON = re.compile("[^\t\n\r -~¡-ɏ]")
SPLIT = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
)


class ByteLevel:
    """Splits texts into the pre-tokens of a byte-level BPE tokenizer file, special strings apart, and maps pre-tokens to ids.

    Texts of common Latin characters are split by one pattern; all others by the tokenizer's own pre-tokeniser, whose offsets
    are exact for every script.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self._apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        if self._apart is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for part in self._apart.split(text):
            out += [part] if part in self.special else self._plain(part)
        return out

    def common(self, text: str) -> bool:
        """Whether the text holds common Latin characters only and no special string."""
        return COMMON.search(text) is None and not any(s in text for s in self.special)

    def _plain(self, text: str) -> list[str]:
        if COMMON.search(text) is None:
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self._whole(text)]

    def _whole(self, text: str):
        """The library reports a character that it splits as a span of its own for each part; spans are made disjoint."""
        end, out = 0, []
        for piece, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            if b > end:
                out.append((piece, (max(a, end), b)))
                end = b
        return out


@functools.cache
def byte_level(path: str) -> ByteLevel:
    """The splitter of a vocabulary file, read once in a Python worker."""
    return ByteLevel(path)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal, non-null key from batches whose rows come sorted by it; a run may span batches."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if kept and kept[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            kept.append(b.slice(i, j - i))
            if j < len(k):
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, joined."""
    heads = np.cumsum(lengths, dtype=np.int64) - lengths
    out = np.repeat((starts - heads).astype(np.int64, copy=False), lengths)
    out += np.arange(len(out))
    return out
