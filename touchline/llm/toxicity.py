"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its words; a document's is the noisy-or of its sentences. The weights are
fitted from document labels alone on a bounded sample (`Settings.rows`), every document is scored in full, and the offending
sentences of a document are those whose own probability reaches the threshold.

Defined results: null or empty text has one empty sentence and gets its probability; every input row gives one output row, so
repeated rows repeat and an empty table gives none; a text of any length is scored whole; of sentences of equal probability the
first is the worst; without any training label of a class the score is the labelled share of toxic rows (0.5 if none). Other
columns keep out of the score, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import WordCache, by_text, labelled_sample, remainder, settle

_END = re.compile(r"[.!?]['\")\]]*$")
_EDGE = " \t.,;:!?\"'()[]{}<>*#$%&|-_"


@dataclass(frozen=True)
class Settings:
    rows: int = 4000  #: labelled rows that the fit sees at most
    words: int = 4_000_000  #: words that the fit sees at most, over all of its rows, which are taken by a hash of doc_id; or one row
    openings: tuple[int, ...] = (5, 6)  #: lengths of the word openings that get weights of their own
    bits: int = 18  #: words are hashed to 2**bits weights
    least: int = 4  #: sampled documents that a word must occur in to get a weight
    steps: int = 160
    rate: float = 0.3
    sparsity: float = 1e-4  #: L1 penalty: words that say little get no weight
    threshold: float = 0.5


def chunks(text: str) -> list[str]:
    """Lower-cased chunks between white space; a line end becomes a chunk of its own that ends a sentence (alone, after a full stop)."""
    return text.lower().replace("\n", " . ").split() or ["."]


def features(chunk: str, settings: Settings) -> list[int]:
    """Buckets of a chunk's word: the word itself and its openings; -1 stands for none."""
    word = chunk.strip(_EDGE)
    forms = [word, *(f"^{word[:n]}" if len(word) >= n else "" for n in settings.openings)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << settings.bits) - 1) if x else -1 for x in forms]


def _sentence_starts(ends: np.ndarray) -> np.ndarray:
    """First chunk of each sentence, from a flag for each chunk that ends one."""
    starts = np.flatnonzero(ends[:-1]) + 1
    return np.concatenate(([0], starts))


def instances(settings: Settings):
    """(doc_id, y, text) batches -> (doc_id, y, words, lengths): buckets of all words, some for each, and words of each sentence."""
    width = 1 + len(settings.openings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(lambda c: (table.append(features(c, settings)), (len(table) - 1) << 1 | bool(_END.search(c)))[1], float("inf"))
        for b in batches:
            words, lengths = [], []
            for t in b.text:
                table = []
                cache.clear()
                c = chunks(t)
                code = np.fromiter(map(cache.__getitem__, c), np.int64, len(c))
                starts = _sentence_starts((code & 1).astype(bool))
                words.append(np.array(table, np.int32).reshape(-1, width)[code >> 1].tobytes())
                lengths.append(np.diff(np.append(starts, len(c))).astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "words": words, "lengths": lengths})

    return run


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    constant: float | None = None


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 5, held: int = 0) -> Model:
    """Noisy-or likelihood, by full-batch Adagrad, over at most `rows` documents and `words` words."""
    sample = labelled_sample(docs, labels, "toxic", modulus, held, settings.rows)
    got = sample.select("doc_id", "y", "text").mapInPandas(
        instances(settings), "doc_id long, y int, words binary, lengths binary"
    )
    width = 1 + len(settings.openings)
    got = settle(got.withColumn("place", F.xxhash64("doc_id")))
    sizes = got.select("place", (F.length("words") / (4 * width)).alias("n")).toPandas().sort_values("place")  # at most `rows` pairs of numbers
    fits = sizes.place[(sizes.n.cumsum() <= settings.words) | (np.arange(len(sizes)) == 0)]
    got = got.where(F.col("place") <= (int(fits.iloc[-1]) if len(fits) else 0)).toPandas().sort_values("doc_id", kind="stable")
    y = got.y.to_numpy(np.float64)
    if len(set(y)) < 2:
        return Model(np.zeros(1 << settings.bits, np.float32), 0.0, float(y.mean()) if len(y) else 0.5)
    lengths = [np.frombuffer(x, np.int32) for x in got.lengths]
    held = [np.frombuffer(x, np.int32) for x in got.words]
    seen = np.zeros((1 << settings.bits) + 1, np.int32)  # the last slot is of -1
    for x in held:
        seen[np.unique(x)] += 1
    seen[-1] = 0
    per_doc = np.array([len(x) for x in lengths])
    per_sentence = np.concatenate(lengths)
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), per_doc)
    keep = [seen[x] >= settings.least for x in held]
    words = np.concatenate([x[k] for x, k in zip(held, keep, strict=True)])
    sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence * width)[np.concatenate(keep)]
    del held, keep
    used, at = np.unique(words, return_inverse=True)
    at = at.astype(np.int32)
    n, first = len(per_sentence), np.cumsum(per_doc) - per_doc
    w, b, gw, gb = np.zeros(len(used)), -5.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(settings.steps):
        z = np.bincount(sentence, w[at], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first)
        q = np.exp(clean)
        pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0)
        g = p * pull[doc_of]
        dw, db = np.bincount(at, g[sentence], len(used)) / len(y), g.sum() / len(y)
        gw += dw * dw
        gb += db * db
        pace = settings.rate / np.sqrt(gw)
        w -= pace * dw
        w = np.sign(w) * np.maximum(np.abs(w) - pace * settings.sparsity, 0)
        b -= settings.rate * db / np.sqrt(gb)
    weights = np.zeros(1 << settings.bits, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def scores(model: Model, settings: Settings):
    """A function of texts: for each its score, sentences, offending sentences and where the worst one stands if it offends."""
    weights, scale = model.weights, 1 << 20

    def look(chunk: str) -> int:
        w = sum(float(weights[k]) for k in features(chunk, settings) if k >= 0)
        return round(w * scale) << 1 | bool(_END.search(chunk))

    cache = WordCache(look)

    def run(texts: list[str | None]) -> list[tuple]:
        rows = []
        for t in texts:
            t = t or ""
            c = chunks(t)
            code = np.fromiter(map(cache.__getitem__, c), np.int64, len(c))
            starts = _sentence_starts((code & 1).astype(bool))
            z = np.clip(np.add.reduceat(code >> 1, starts) / scale + model.bias, -30, 30)
            p = 1 / (1 + np.exp(-z))
            if model.constant is None:
                value = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
                span = _span(t, c, starts, int(p.argmax())) if value >= settings.threshold else (None, None)
                rows.append((value, len(p), int((p >= settings.threshold).sum()), *span))
            else:
                rows.append((model.constant, len(p), 0, None, None))
        return rows

    return run


def scorer(model: Model, settings: Settings):
    """Batches with doc_id and text -> SCORES."""

    def step():
        of = scores(model, settings)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*of(b.column("text").to_pylist()), strict=True)) or [[]] * 5
            kinds = (pa.float64(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "score", "sentences", "offending", "worst_start", "worst_end"],
            )

        return run

    return by_text(step)


def _span(text: str, c: list[str], starts: np.ndarray, k: int) -> tuple[int, int]:
    """Where sentence k stands in the text; chunks made of line ends have no width."""
    words = [m.span() for m in re.finditer(r"\n|[^\s]+", text)]
    if len(words) != len(c):  # other line separators or a letter that changes length in lower case
        return 0, len(text)
    end = int(starts[k + 1]) - 1 if k + 1 < len(starts) else len(c) - 1
    return words[int(starts[k])][0], words[end][1]


SCORES = "doc_id long, score double, sentences long, offending long, worst_start long, worst_end long"


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scorer(model, settings), SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and where the worst sentence stands."""
    scored = score(docs, fit(docs, labels, settings), settings)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
        "sentences", "offending", "worst_start", "worst_end",
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    model = fit(docs, labels, settings)

    def step():
        of = scores(model, settings)
        return lambda b: b.filter(pa.array([r[0] < settings.threshold for r in of(b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(by_text(step), docs.schema)
