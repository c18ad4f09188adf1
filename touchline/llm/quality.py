"""Quality classifier: a generalised additive model with pairwise interactions.

Surface features of the whole text are binned; cyclic boosting of shallow trees, one feature at a time, learns a lookup table
per feature, then trees on the strongest pairs learn two-way tables. A score is the logistic of the tables' entries added up
for all documents of a batch at once.

Defined results: null and empty texts have the features of an empty text and are scored; one output row per input row, so repeated
rows repeat and an empty table gives none; a text of any length is measured whole; of equally strong pairs of features and equally
good splits the first counts; if the labels hold one class only, the score is that share (0.5 without labels). Other columns keep out
of the score, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import by_text, labelled_sample, remainder

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "stop", "wide", "line_share",
    "distinct_words", "top_word", "distinct_lines", "words_per_line", "upper_words", "marked_words", "pipe", "bang",
    "short_words", "comma",
)


@dataclass(frozen=True)
class Settings:
    rows: int = 20_000  #: labelled rows that the fit sees at most
    bins: int = 48
    pair_bins: int = 12
    rounds: int = 200
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.1
    leaf: int = 10  #: documents in a leaf at least
    threshold: float = 0.7


def _classes() -> np.ndarray:
    """256 byte values x 8 classes."""
    out = np.zeros((256, 8))
    for i in range(256):
        c = chr(i)
        out[i] = (
            "A" <= c <= "Z", "0" <= c <= "9", 32 < i < 127 and not c.isalnum(), c in "#$%&*@^~+=<>/\\|_", c in ".?!", i > 127,
            c == "\n", c == ",",
        )
    return out


_CLASSES = _classes()


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    upper, digit, mark, symbol, stop, wide, line, comma = np.bincount(raw, minlength=256) @ _CLASSES / n
    words = text.split()
    w = max(len(words), 1)
    often = Counter(words)
    lines = [x for x in text.split("\n") if x]
    short = sum(c for x, c in often.items() if len(x) <= 2)
    marked = sum(c for x, c in often.items() if not x[-1].isalnum() and len(x) > 2)
    capital = sum(c for x, c in often.items() if len(x) > 1 and x.isupper())
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, upper, digit, mark, symbol, stop, wide,
        line * n / w, len(often) / w, max(often.values(), default=0) / w, len(set(lines)) / max(len(lines), 1),
        w / max(len(lines), 1), capital / w, marked / w, text.count("|") / w, text.count("!") / w, short / w, comma,
    ]


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  #: bin -> bin of the pair tables

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.tables:
            at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
            for t, i in zip(self.tables, at, strict=True):
                z += t[i]
            for j, k, t in self.pairs:
                z += t[self.coarse[j][at[j]], self.coarse[k][at[k]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _steps(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaf: int, depth: int) -> np.ndarray:
    """Leaf values, by bin, of a tree of `depth` splits-in-a-row over ordered bins with gradient, curvature and count sums."""
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    value = cg[-1] / (ch[-1] + 1.0)
    if depth and len(g) > 1:
        lg, lh, ln = cg[:-1], ch[:-1], cn[:-1]
        gain = lg**2 / (lh + 1) + (cg[-1] - lg) ** 2 / (ch[-1] - lh + 1)
        gain[(ln < leaf) | (cn[-1] - ln < leaf)] = -1
        k = int(gain.argmax())
        if gain[k] > cg[-1] ** 2 / (ch[-1] + 1) + 1e-9:
            left, right = slice(0, k + 1), slice(k + 1, None)
            return np.concatenate([_steps(g[s], h[s], n[s], leaf, depth - 1) for s in (left, right)])
    return np.full(len(g), value)


def _crossed(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaf: int) -> np.ndarray:
    """A tree over two features: the rows are split once, then the columns on either side; the other way round if better."""

    def one(g, h, n):
        best, out = -np.inf, np.zeros_like(g)
        for k in range(1, len(g)):
            parts = [(s, _steps(g[s].sum(0), h[s].sum(0), n[s].sum(0), leaf, 1)) for s in (slice(0, k), slice(k, None))]
            gain = sum((v * g[s].sum(0) - 0.5 * v * v * (h[s].sum(0) + 1e-3)).sum() for s, v in parts)
            if gain > best:
                best, out = gain, np.concatenate([np.broadcast_to(v, g[s].shape) for s, v in parts])
        return best, out

    (a, x), (b, y) = one(g, h, n), one(g.T, h.T, n.T)
    return x if a >= b else y.T


def boost(x: np.ndarray, y: np.ndarray, settings: Settings) -> Model:
    """Fit the tables; y holds 0 and 1."""
    if not len(y):
        return Model(0.0)
    share = float(y.mean())
    if not 0 < share < 1:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))))
    m = Model(float(np.log(share / (1 - share))))
    for j in range(x.shape[1]):
        m.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, settings.bins + 1)[1:-1])))
        m.tables.append(np.zeros(len(m.edges[-1]) + 1))
        m.coarse.append(np.arange(len(m.tables[-1])) * settings.pair_bins // (len(m.tables[-1])))
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    z = np.full(len(y), m.bias)

    def sums(i, size):
        p = 1 / (1 + np.exp(-z))
        return np.bincount(i, y - p, size), np.bincount(i, p * (1 - p), size), np.bincount(i, minlength=size)

    for _ in range(settings.rounds):
        for j, t in enumerate(m.tables):
            step = settings.rate * _steps(*sums(at[j], len(t)), settings.leaf, 2)
            t += step
            z += step[at[j]]
    b, side = [m.coarse[j][i] for j, i in enumerate(at)], settings.pair_bins
    flat = {(j, k): b[j] * side + b[k] for j in range(len(b)) for k in range(j)}

    def strength(i):
        g, h, _ = sums(i, side * side)
        return float((g * g / (h + 5)).sum())

    for j, k in sorted(flat, key=lambda q: (-strength(flat[q]), q))[: settings.pairs]:
        m.pairs.append((j, k, np.zeros((side, side))))
    for _ in range(settings.pair_rounds):
        for j, k, t in m.pairs:
            i = flat[j, k]
            step = settings.rate * _crossed(*(s.reshape(side, side) for s in sums(i, side * side)), settings.leaf)
            t += step
            z += step.ravel()[i]
    return m


def _measured(b: pa.RecordBatch) -> pa.RecordBatch:
    x = [features(t) for t in b.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 4, held: int = 2) -> Model:
    sample = labelled_sample(docs, labels, "quality", modulus, held, settings.rows)
    got = sample.select("y", "text").mapInArrow(by_text(lambda: _measured), "y int, x array<double>").toPandas()
    x = np.array(got.x.tolist()).reshape(len(got), len(FEATURES))
    order = np.lexsort((got.y.to_numpy(), *x.T))
    return boost(x[order], got.y.to_numpy(float)[order], settings)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, settings)

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_text(lambda: scored), "doc_id long, score double")
    return rows.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
