"""Audit of how sources of one language differ in their words, by DuckDB over shards.

1. Each task counts the terms of its texts in DuckDB, some megabytes at a time: occurrences and documents by (lang, source, term).
   Only these counts are shuffled, so a source that holds a third of all documents, or a word that all of them hold, sends a row for
   each of these portions.
2. Counts are dealt to shards by a hash of (lang, term). DuckDB sums them in each shard and keeps the terms that enough documents of
   the language hold. Spark adds the totals of sources and languages up.
3. The kept counts, with the totals of their source, go to shards by the same hash. DuckDB turns them into shares, sums the
   differences of each two sources over the shard's terms and ranks the shard's first terms of each source. Spark merges both.

A term that a source does not hold has that source's least share b. With p the share where it is held, the sum over all V kept terms of
|p(s) - p(t)| is V * |b(s) - b(t)|, plus for each term of one of the two what it adds against the other's b, plus a correction for the
terms that both hold. The second part needs only how many terms of a source have which count, the third is the partial sum of the
shards. So terms that are not there are never spelled out. All numbers are whole; products are taken with 38 digits.

Defined results: null texts, languages and sources are ''; every row is a document, also a repeated one; a language without kept terms
has V = 0 and differences of 0; an empty table gives no rows. A text of any length counts whole: it is cut between terms, and only its
distinct terms are held. Memory is bounded by the portion (`Settings.portion`) and by a shard's counts; shards are as many as
spark.sql.shuffle.partitions. Other columns are not read, whatever their names. The result has a row for each two sources of a
language, which the definition asks for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import give_back, regrouped, settle

BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@dataclass(frozen=True)
class Settings:
    documents: int = 30  #: of a language that hold a kept term, at least
    top: int = 50  #: terms reported for each source
    scale: int = 1_000_000_000  #: parts of a share
    prior: int = 5  #: added to each count
    portion: int = 16 << 20  #: bytes of text counted at once, or one document
    piece: int = 16 << 10  #: characters after which a text is cut at the next place between terms


def _duck():
    """DuckDB in memory, on one thread, without files of its own."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _ask(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in con.sql(sql).to_arrow_reader(50_000):
        yield batch.cast(schema)


def pieces(text: str, size: int) -> Iterator[str]:
    """The text, cut between terms."""
    start = 0
    while len(text) - start > size:
        cut = BETWEEN.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


PIECES = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("piece", pa.string())])
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
SIZED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), *[(c, pa.int64()) for c in ("n", "total", "all", "v")]])
RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

COUNT = f"""
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (
  SELECT "row", lang, source, term, count(*) AS n
  FROM (SELECT "row", lang, source, unnest(regexp_extract_all({LOWER.format("piece")}, '{TERM}')) AS term FROM pieces) GROUP BY ALL
) GROUP BY ALL
"""


def _counted(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, source, text) -> COUNTS of each portion."""

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for i, (lang, source, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True)):
            for piece in pieces(text, settings.piece):
                rows.append((i, lang, source, piece))
                size += len(piece)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for b in regrouped(batches, settings.portion):
            con.register("pieces", pa.RecordBatchReader.from_batches(PIECES, cut(b)))
            yield from _ask(con, COUNT, COUNTS)
        con.close()
        give_back()

    return run


def _sharded(read: pa.Schema, table: str, questions: list[tuple[str, pa.Schema]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A shard's rows, taken into DuckDB by `table`, then the rows that `questions` ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.register("rows", pa.RecordBatchReader.from_batches(read, batches))
        con.execute(f"CREATE TABLE shard AS {table}")
        for sql, schema in questions:
            yield from _ask(con, sql, schema)
        con.close()
        give_back()

    return run


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def kept(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts (lang, source, term, n) of the terms that enough documents of the language hold; first is 1 in one row of each
    (lang, term)."""
    counts = docs.mapInArrow(_counted(settings), _ddl(COUNTS)).repartition("lang", "term")
    summed = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM rows GROUP BY ALL"
    enough = f"""
      SELECT lang, source, term, n, CAST(source = min(source) OVER w AS BIGINT) AS first FROM shard
      WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {settings.documents}"""
    return settle(counts.mapInArrow(_sharded(COUNTS, summed, [(enough, KEPT)]), _ddl(KEPT)))


def shares(settings: Settings, n: str, total: str, v: str) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * v)), null without kept terms."""
    return F.expr(f"1 + (cast({settings.scale} as decimal(10, 0)) * ({n} + {settings.prior})) div nullif({total} + {settings.prior} * {v}, 0)")


def totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each (lang, source) of the documents: its occurrences of kept terms, those of the language and the number V of these
    terms."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("all"), F.sum("first").alias("v"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("documents"))
    out = groups.join(own.drop("first"), ["lang", "source"], "left").join(langs, "lang", "left")
    return settle(out.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "all", "v")]))


def _parts(settings: Settings) -> list[tuple[str, pa.Schema]]:
    """The shard's share of the differences of two sources beyond their terms taken singly, and its first terms of each source."""
    both = """
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p) - abs(a.p - b.b) - abs(a.b - b.p) + abs(a.b - b.b)) AS BIGINT) AS value
      FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL"""
    terms = f"""
      SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shard WHERE p > q
      QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {settings.top}"""
    return [(both, RESULT), (terms, RESULT)]


def audit(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): differences from each other source of the language, and first terms."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = kept(docs, settings)
    groups = totals(docs, counts)
    s, k = f"{settings.scale}::HUGEINT", settings.prior
    table = f"""
      SELECT lang, source, term, 1 + {s} * (n + {k}) // (total + {k} * v) AS p, 1 + {s} * {k} // (total + {k} * v) AS b,
        1 + {s} * (sum(n) OVER (PARTITION BY lang, term) + {k}) // ("all" + {k} * v) AS q FROM rows"""
    sized = counts.join(groups, ["lang", "source"]).select(*SIZED.names).repartition("lang", "term")
    found = settle(sized.mapInArrow(_sharded(SIZED, table, _parts(settings)), _ddl(RESULT)))

    base = groups.withColumn("b", shares(settings, "0", "total", "v"))
    other = base.select("lang", F.col("source").alias("item"), F.col("b").alias("c"))
    far = F.abs(F.col("b") - F.col("c"))
    skeleton = base.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * far, F.lit(0)).alias("value"))
    tally = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    single = tally.join(base, ["lang", "source"]).withColumn("p", shares(settings, "n", "total", "v")).join(other, "lang").where("source <> item")
    single = single.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("c")) - far)).alias("value"))
    one_way = single.union(found.where("part = 'pair'").select("lang", "source", "item", "value"))
    ways = one_way.union(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = skeleton.union(ways).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(first)) for rows in (pairs, found.where("part = 'term'"))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= settings.top))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), held AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sources AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n, sum(coalesce(h.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total, sum(coalesce(h.n, 0)) OVER (PARTITION BY s.lang, k.term) AS n_lang,
    sum(coalesce(h.n, 0)) OVER (PARTITION BY s.lang) AS total_lang, (SELECT count(*) FROM kept x WHERE x.lang = s.lang) AS v
  FROM sources s JOIN kept k ON k.lang = s.lang LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v) AS p, 1 + 1000000000::HUGEINT * (n_lang + 5) // (total_lang + 5 * v) AS q FROM dense
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
