"""Periodic runs of words by counting matches at every lag.

A run is a stretch of consecutive words with smallest period q that is at least `Settings.least` words and `2 * q` words long and that
no neighbouring word extends. Such a run gives lag q at least max(q, least - q) matches (a word equal to the word q places on) in one
island, so a lag with fewer matches in the whole text holds none.

* Counting. The matches at all lags up to half the text are counted at once. A frequent ("heavy") word is counted by the FFT
  autocorrelation of its 0/1 places; spectra of all heavy words are summed and transformed back once, and the rounded counts are exact.
  A rare ("light") word is counted by the differences of its places. A word is heavy if its pairs cost more than a transform, so
  counting takes n * sqrt(n * log n) steps at most.
* Scanning. Lags are taken in ascending order. Only those with enough matches are scanned for islands. An island of m places
  holds about eight of the places that are multiples of m / 8; only where so many in a row match are all places compared. A run found
  at lag q has L - k * q matches at lag k * q, which form an island by themselves; they are taken off that lag's count, so that one
  long run does not have all its multiples scanned.

Defined results: a null text has no words and no runs; an empty table gives no rows; repeated rows and ids give a row each; a null id
stays null. Texts of any length are taken whole: memory is some 100 bytes a word of one text. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import by_text, gather

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass(frozen=True)
class Settings:
    least: int = 12  #: words of a run
    probes: int = 8  #: places of an island that are compared before all are
    pairs: int = 1 << 21  #: differences of light words that are held at once


def numbered(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def lag_counts(x: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """At p: the number of places i with x[i] == x[i + p], for p from 0 (left at 0) to half the length."""
    n, top = len(x), len(x) // 2
    out = np.zeros(top + 1, np.int64)
    if top < 1:
        return out
    size = 1 << (n + top).bit_length()
    often = np.bincount(x)
    heavy = often.astype(np.float64) ** 2 > size * size.bit_length() / 4
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy):
            f = np.fft.rfft(x == w, size)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)
    at = np.flatnonzero((~heavy & (often > 1))[x])
    at = at[np.argsort(x[at], kind="stable")]
    word = x[at]
    last = np.flatnonzero(np.append(word[1:] != word[:-1], True)) if len(at) else at
    later = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(at))  # places of the same word after this one
    block = (np.cumsum(later) - later) // settings.pairs
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(at)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.arange(i, j)
        lag = at[gather(first + 1, later[i:j])] - np.repeat(at[i:j], later[i:j])
        out += np.bincount(lag[lag <= top], minlength=top + 1)
    out[0] = 0
    return out


def _islands(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each stretch of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _scan(x: np.ndarray, lag: int, least: int, probes: int) -> Iterator[tuple[int, int]]:
    """Islands of at least `least` matches at a lag."""
    n, step = len(x) - lag, max(1, least // probes)
    if step == 1:
        spans = [(0, n)]
    else:
        first, after = _islands(x[:n:step] == x[lag::step])
        full = after - first >= least // step
        spans = [(max(0, (a - 1) * step + 1), min(n, b * step)) for a, b in zip(first[full].tolist(), after[full].tolist(), strict=True)]
    for low, high in spans:
        a, b = _islands(x[low:high] == x[low + lag : high + lag])
        for i in np.flatnonzero(b - a >= least):
            yield low + int(a[i]), low + int(b[i])


def find(x: np.ndarray, settings: Settings = Settings()) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    left, runs = lag_counts(x, settings), {}
    lags = np.arange(len(left))
    for q in np.flatnonzero((left >= np.maximum(lags, settings.least - lags)) & (lags > 0)).tolist():
        need = max(q, settings.least - q)
        if left[q] < need:  # runs of shorter periods have taken their share
            continue
        for a, b in _scan(x, q, need, settings.probes):
            if (a, b + q) not in runs:
                runs[a, b + q] = q
                multiples = np.arange(2 * q, min(b + q - a, len(left)), q)
                left[multiples] -= b + q - a - multiples
    return sorted((a, end - a, q) for (a, end), q in runs.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a run holds the word after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def _of(settings: Settings) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def step() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            count, found, texts = [], [], []
            for text in b.column("text").to_pylist():
                words = WORD.findall(text or "")
                runs = find(numbered(words), settings) if len(words) >= settings.least else []
                if runs:
                    gone = dropped(len(words), runs).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                    count.append(len(gone))
                else:
                    count.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [b.column("doc_id"), pa.array(count, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        return batch

    return step


def runs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: its number of words, its runs by start, then period, and its words, joined by blanks, without those that a run
    repeats after its first period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_text(_of(settings)), OUT)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document by crc32 of its id repeats a stretch of its words to its end; the others stay.

    With h = crc32(doc_id as text), g = h // 10 and n words: from word a = g % n on, words repeat with period
    1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def altered(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.concat_ws(" ", F.transform(at, lambda i: F.get(w, i.cast("int"))))).otherwise("")

    once = F.get(F.transform(F.array(words), altered), F.lit(0))  # a lambda's variable is worked out once, not for each word
    return docs.select("doc_id", F.when(h % 10 == 0, once).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The runs of the planted documents: their number, the longest one, and digests of all of them and of the collapsed text."""
    found = runs(planted(docs))
    longest = F.array_sort("runs", _longer)[0]
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.when(F.size("runs") > 0, longest)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best")["length"] * 1000 / F.col("best")["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _longer(x: Column, y: Column) -> Column:
    """Longer runs first, then earlier ones, then shorter periods."""
    order = [(y["length"], x["length"]), (x["start"], y["start"]), (x["period"], y["period"])]
    out = F.lit(0)
    for a, b in reversed(order):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


ORACLE = r"""
WITH ids AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, c: list_reduce(list_prepend(xor(x, c), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS h
  FROM documents
), planted AS (
  SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS alter, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM ids
), texts AS (
  SELECT r, doc_id, n, CASE WHEN alter THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE w END AS w FROM planted
), tokens AS (
  SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts
), matches AS (
  SELECT a.r, b.i - a.i AS p, a.i FROM tokens a JOIN tokens b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 2 * (b.i - a.i) <= a.n
), islands AS (
  SELECT r, p, min(i) AS start, count(*) + p AS length FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM matches) GROUP BY r, p, g
), runs AS (
  SELECT r, start, length, min(p) AS period FROM islands WHERE length >= greatest(12, 2 * p) GROUP BY r, start, length
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT t.r, string_agg(t.word, ' ' ORDER BY t.i) AS s FROM tokens t ANTI JOIN gone g ON g.r = t.r AND g.i = t.i GROUP BY t.r
), best AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
    first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS b FROM runs GROUP BY r
)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(s, '')) AS collapsed_sha256
FROM texts x LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
