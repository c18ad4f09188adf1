"""Benchmark decontamination by latent semantic retrieval.

Inverse document frequencies come from all documents. The TF-IDF rows of the benchmark's passages, in blocks of bounded size, go
through a randomised SVD whose products are Spark aggregates; the windows of every document, of doubling sizes up to the longest
item, are folded into that space and held against all items of the block by cosine, save those too light to cover even the lightest
item. An item's rarest runs of three words, one from each part of it, are looked up as well: a verbatim copy holds them all, so it is
always a candidate. Candidates are then checked on the words themselves: the longest common subsequence of item and surrounding text, and whether the item's answer (its last sentence) is there too. An item counts as leaked if nearly
all of its words follow in order, or if a good part does and the answer is found, which catches paraphrases.

Words are runs of letters and digits; in scripts without spaces each character is one.

Defined results: null and empty texts and items match nothing; items without words are ignored; a repeated document row gives
its own result rows; a repeated item id gives the best row of its texts, of equal ones the greatest by share, cosine, answer and
place; empty tables give no rows. A text of any length is searched whole. Other columns are not read, and stay as they are where
documents are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import by_text, runs, settle, slices

#: Bytes between words: white space, other controls and ASCII punctuation.
_BETWEEN = np.array([i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
PART = 1 << 20  #: bytes of text that are taken apart at once, or one document
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@dataclass(frozen=True)
class Settings:
    bits: int = 17  #: words are hashed to 2**bits terms
    items: int = 512  #: benchmark items in a block, which bounds its matrices on the driver and in the tasks
    terms: int = 150_000  #: rows of terms, of all blocks together, after which a pass over the documents ends; 4 * rank bytes each
    rank: int = 96
    oversample: int = 16
    tile: int = 8  #: windows hold 2, 4, 8 ... tiles of a document; up to 8 they begin at every tile, larger ones at every eighth part
    cosine: float = 0.6  #: in the latent space
    cover: float = 0.4  #: share of an item, in the latent space, that a window covers
    seeds: int = 8  #: parts of an item that give a run of words to look up; half of them make a candidate
    run: int = 3  #: words in such a run, or all words of a shorter item
    sure: float = 0.8  #: share of an item's words, in order, that is a leak by itself
    likely: float = 0.5  #: share that is a leak if the answer is there
    answer: float = 0.8  #: share of the answer's words, in order, that counts as there
    common: float = 0.05  #: of an item's terms, those in more than this share of the documents count only if in its rarer half
    seed: int = 5


class Terms:
    """Splits texts into words and hashes all words of many texts at once.

    Every byte is weighed by a power of an odd base modulo 2**64; a word's hash is the difference of two running sums, brought back
    to the power of its first byte. Letters A-Z and the accented ones of Latin-1 are lower-cased.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.power = self.back = np.ones(1, np.uint64)

    def _room(self, n: int) -> None:
        if n > len(self.power):
            for name, base in (("power", _BASE), ("back", _BACK)):
                x = np.full(max(n, 2 * len(self.power)), base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def __call__(self, texts: list[str | None]) -> "Split":
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
        self._room(len(raw) + 1)
        low = _LOWER[raw]
        if len(raw) > 1:
            accented = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
            low[accented] |= 0x20
        inside = np.concatenate(([False], ~_BETWEEN[raw], [False]))
        cut = _single(raw, inside)
        start = np.flatnonzero(inside[1:] & (cut[:-1] | ~inside[:-1]))
        end = np.flatnonzero(inside[:-1] & (cut[:-1] | ~inside[1:]))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(low * self.power[: len(raw)], out=sums[1:], dtype=np.uint64)
        h = (sums[end] - sums[start]) * self.back[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_BASE)
        ids = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return Split(low, start, end, np.searchsorted(start, ends), ids)


def _single(raw: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where a character begins, or has just ended, that is a word by itself, as in scripts without spaces; CJK marks go from `inside`."""
    cut = np.zeros(len(raw) + 2, bool)
    lead = np.flatnonzero((raw >= 0xE0) & (raw <= 0xE9))
    lead = lead[lead + 2 < len(raw)]
    if len(lead):
        first, second = raw[lead], raw[lead + 1]
        south = (first == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
        south |= (first == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
        at = lead[(first >= 0xE3) | south]
        cut[at] = cut[at + 3] = True
        mark = lead[(first == 0xE3) & (second == 0x80)] + 1
        inside[mark] = inside[mark + 1] = inside[mark + 2] = False
    return cut


@dataclass
class Split:
    """Words of several texts in a row: where each begins and ends, where each text's words end, and the words' terms."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ends: np.ndarray
    ids: np.ndarray

    def words(self, a: int, b: int) -> list[str]:
        raw = self.bytes.tobytes() if b - a == len(self.start) else None
        cut = (lambda i, j: raw[i:j]) if raw is not None else (lambda i, j: self.bytes[i:j].tobytes())
        return [cut(i, j).decode("utf-8", "replace") for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def plain(text: str | None) -> list[str]:
    """Words of a text in lower case."""
    got = Terms(1)([text])
    return got.words(0, len(got.start))


def answer_of(text: str) -> list[str]:
    """The last sentence that has three words or more, or else all words."""
    for s in reversed([x for x in re.split(r"[.!?。！？\n]+", text) if x.strip()]):
        if len(plain(s)) >= 3:
            return plain(s)
    return plain(text)


def document_frequency(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and the number of documents; 2**bits counts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, n = Terms(settings.bits), np.zeros((1 << settings.bits) + 1, np.int64), 0
        for part in (x for b in batches for x in slices(b, "text", PART)):
            texts = part.column("text").to_pylist()
            n += len(texts)
            for i in range(0, len(texts), 256):
                got = of(texts[i : i + 256])
                doc = np.repeat(np.arange(len(got.ends)), np.diff(got.ends, prepend=0))
                once = np.unique(doc << settings.bits | got.ids) & ((1 << settings.bits) - 1)
                counts += np.bincount(once, minlength=len(counts))
        counts[-1] = n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << settings.bits) + 1, np.int64)
    out[got.term] = got.n
    return out[:-1], int(out[-1])


def weights(frequency: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies."""
    return np.log((n + 1) / (frequency + 0.5)).astype(np.float32)


@dataclass
class Space:
    """Latent space of one block: a row of `terms` for each term that its items hold, a row of `items` for each item."""

    row: np.ndarray  #: term -> row of terms, 0 for none
    terms: np.ndarray
    items: np.ndarray
    names: list[int]
    texts: list[list[str]]
    answers: list[list[str]]


def latent_space(items: DataFrame, idf: np.ndarray, settings: Settings) -> Space:
    """Randomised SVD of the TF-IDF matrix of a block of items(row, item_id, text).

    The sketch A*Omega is taken row by row and the projection Q'A term by term, both in Spark; the driver sees two matrices of
    (rank + oversample) columns, one row for each item and each term of the block.
    """
    here = items.sparkSession.sparkContext.broadcast(idf)
    least = float(-np.log(settings.common))
    size, bits, seed = settings.rank + settings.oversample, settings.bits, settings.seed

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(bits)
        for b in batches:
            out = []
            for r, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                at, tf = np.unique(of([t]).ids, return_counts=True)
                weight = here.value[at]
                x = np.where((weight >= least) | (weight >= np.median(weight)), tf * weight, 0) if len(at) else np.zeros(0)
                size = float(np.linalg.norm(x)) or 1.0
                out += [(r, int(i), float(v) / size, size) for i, v in zip(at, x, strict=True) if v > 0]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "term", "x", "size"])

    a = items.select("row", "text").mapInArrow(entries, "row long, term long, x double, size double")
    rows = a.groupBy("row").agg(F.collect_list(F.struct("term", "x")).alias("v"), F.max("size").alias("size"))  # an item's own terms

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = []
            for v in b.column("v").to_pylist():
                omega = np.stack([np.random.default_rng([seed, e["term"]]).standard_normal(size) for e in v])
                y.append(np.array([e["x"] for e in v]) @ omega)
            y = pa.array([q.tolist() for q in y], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("row"), y, b.column("size")], names=["row", "y", "size"])

    sketch = rows.mapInArrow(sketched, "row long, y array<double>, size double").toPandas().sort_values("row")  # at most a block of rows
    named = {r.row: r for r in items.select("row", "item_id", "text").collect()}
    if not len(sketch):
        return Space(np.zeros(1 << bits, np.int32), np.zeros((1, 1), np.float32), np.zeros((0, 1), np.float32), [], [], [])
    y, size_of = np.array(sketch.y.tolist()), dict(zip(sketch.row, sketch["size"], strict=True))
    q, _ = np.linalg.qr(y)
    place = {r: q[i] for i, r in enumerate(sketch.row)}

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "term"):
            x = np.array(t.column("x")) @ np.stack([place[r] for r in t.column("row").to_pylist()])
            yield pa.RecordBatch.from_arrays([t.column("term").combine_chunks()[:1], pa.array([x.tolist()], pa.list_(pa.float64()))], names=["term", "b"])

    by_term = a.repartition("term").sortWithinPartitions("term").mapInArrow(projected, "term long, b array<double>").toPandas()
    by_term = by_term.sort_values("term")
    used, b = by_term.term.to_numpy(), np.array(by_term.b.tolist()).T
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    keep = min(settings.rank, int((s > 1e-9 * s[0]).sum()))
    terms = np.concatenate([np.zeros((1, keep)), vt[:keep].T]).astype(np.float32)
    where = np.zeros(1 << bits, np.int32)
    where[used] = np.arange(1, len(used) + 1)
    latent = (q @ u)[:, :keep] * s[:keep]
    latent *= np.array([size_of[r] for r in sketch.row])[:, None]  # as long as the item's own weights make it
    order = [named[r] for r in sketch.row]
    return Space(where, terms, latent.astype(np.float32), [r.item_id for r in order], [plain(r.text) for r in order], [answer_of(r.text) for r in order])


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit for each word of a."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w)
        if m is not None:
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _doubled(x: np.ndarray, doc: np.ndarray, step: int) -> np.ndarray:
    """Each entry and the one `step` places on in the same document, added; entries near its end stand alone."""
    out = x.copy()
    same = np.flatnonzero(doc[:-step] == doc[step:])
    out[same] += x[same + step]
    return out


def _runs_of_words(ids: np.ndarray, size: int, bits: int) -> np.ndarray:
    """One number for each run of so many terms."""
    out = np.zeros(max(0, len(ids) - size + 1), np.int64)
    for k in range(size):
        out = out << bits | ids[k : k + len(out)]
    return out


@dataclass
class Seeds:
    """Runs of `size` words to look up: sorted keys, and for each the item, its part and the place in the item."""

    size: int
    sieve: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    part: np.ndarray
    place: np.ndarray


_SIEVE = 20


def _sieved(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - _SIEVE)).astype(np.int64)


def _seeds(space: Space, idf: np.ndarray, settings: Settings) -> tuple[list[Seeds], np.ndarray]:
    """The seeds of a block by size of run, and the number of seeds of each item."""
    of, rows, count = Terms(settings.bits), {}, np.zeros(len(space.texts), np.int64)
    for j, words in enumerate(space.texts):
        ids = of([" ".join(words)]).ids
        size = min(settings.run, len(ids))
        keys = _runs_of_words(ids, size, settings.bits)
        rare = np.convolve(idf[ids], np.ones(size), "valid")
        parts = np.array_split(np.arange(len(keys)), min(settings.seeds, len(keys)))
        count[j] = len(parts)
        for k, part in enumerate(parts):
            at = part[np.argmax(rare[part])]
            rows.setdefault(size, []).append((keys[at], j, k, at))
    out = []
    for size, some in rows.items():
        keys, item, part, place = np.array(sorted(some), np.int64).T
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[_sieved(keys)] = True
        out.append(Seeds(size, sieve, keys, item, part, place))
    return out, count


def _seeded(seeds: list[Seeds], count: np.ndarray, ids: np.ndarray, doc: np.ndarray, settings: Settings) -> Iterator[tuple[int, int, int]]:
    """(document, item, first word of the item) of the items of which a document holds half of the seeds."""
    for s in seeds:
        keys = _runs_of_words(ids, s.size, settings.bits)
        at = np.flatnonzero(s.sieve[_sieved(keys)])
        at = at[doc[at] == doc[at + s.size - 1]]
        low, high = np.searchsorted(s.keys, keys[at], "left"), np.searchsorted(s.keys, keys[at], "right")
        n = high - low
        if not n.any():
            continue
        seed = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        pair = doc[at].astype(np.int64) * len(count) + s.item[seed]
        once = np.unique(np.stack([pair, s.part[seed]]), axis=1)[0]
        pairs, parts = np.unique(once, return_counts=True)
        enough = pairs[2 * parts >= count[pairs % len(count)]]
        for k in np.flatnonzero(np.isin(pair, enough)).tolist():
            yield int(pair[k]) // len(count), int(s.item[seed[k]]), int(at[k] - s.place[seed[k]])


def search(space: Space, idf: np.ndarray, settings: Settings):
    """A function of texts: for each text its leaked items, as (item, cosine, share of words, share of answer, first word)."""
    terms, tile = Terms(settings.bits), settings.tile
    weighted = np.zeros_like(space.terms)  # each term's row times its weight
    weighted[space.row[space.row > 0]] = space.terms[space.row[space.row > 0]] * idf[space.row > 0][:, None]
    length = np.maximum(np.linalg.norm(space.items, axis=1), 1e-9)
    latent = np.ascontiguousarray((space.items / length[:, None]).T)
    seeds, count = _seeds(space, idf, settings)
    longest, lightest = max(map(len, space.texts), default=0), settings.cover * length.min(initial=np.inf)

    def cosine(j: int, words: np.ndarray) -> float:
        x = weighted[words].sum(axis=0)
        return float(x @ latent[:, j] / max(np.linalg.norm(x), 1e-9))

    def run(texts: list[str | None]) -> list[dict[int, tuple]]:
        out: list[dict[int, tuple]] = [{} for _ in texts]
        got = terms(texts)
        ids, ends, total = got.ids, got.ends, len(got.ids)
        if not total or not space.names:
            return out
        row = space.row[ids]
        begins = np.concatenate(([0], ends[:-1]))
        doc_of = np.repeat(np.arange(len(ends)), ends - begins)
        found: dict[tuple[int, int], tuple[float, list]] = {}
        for d, j, a in _seeded(seeds, count, ids, doc_of, settings):
            a, b = max(a, int(begins[d])), min(a + len(space.texts[j]), int(ends[d]))
            best, spans = found.get((d, j), (-1.0, []))
            found[d, j] = (max(best, cosine(j, row[a:b])), spans)
            spans.append((a, b))
        at = np.flatnonzero(row)
        tiles = -(-(ends - begins) // tile)  # of each document
        doc = np.repeat(np.arange(len(ends)), tiles)
        first = np.cumsum(tiles) - tiles
        place = np.arange(len(doc)) - first[doc]
        tile_of = first[doc_of[at]] + (at - begins[doc_of[at]]) // tile
        vectors = np.zeros((len(doc), weighted.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(tile_of, prepend=-1))
        if len(full):
            vectors[tile_of[full]] = np.add.reduceat(weighted[row[at]], full, axis=0)
        size, stride = 1, 1
        while len(at) and (size < 8 or size * tile < longest):
            if size >= 8:
                even = np.flatnonzero(place % 2 == 0)
                doc, place, vectors, stride = doc[even], place[even] // 2, vectors[even], 2 * stride
            vectors = _doubled(vectors, doc, size // stride)
            size *= 2
            norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            heavy = np.flatnonzero(norm >= max(lightest, 1e-9))
            for k in range(0, len(heavy), 4096):
                w = heavy[k : k + 4096]
                near = vectors[w] @ latent
                close = near >= settings.cosine * norm[w][:, None]
                close &= near >= settings.cover * length
                for i, j in zip(*(x.tolist() for x in np.nonzero(close)), strict=True):
                    d = int(doc[w[i]])
                    a = int(begins[d]) + int(place[w[i]]) * stride * tile
                    best, spans = found.get((d, j), (-1.0, []))
                    found[d, j] = (max(best, float(near[i, j] / norm[w[i]])), spans)
                    spans.append((a, min(a + size * tile, int(ends[d]))))
        for (d, j), (c, spans) in found.items():
            begin, end = int(ends[d - 1]) if d else 0, int(ends[d])
            item, answer = space.texts[j], space.answers[j]
            margin = len(item) + 8
            regions: list[list[int]] = []
            for a, b in sorted(spans):
                a, b = max(begin, a - margin), min(end, b + margin)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = max(b, regions[-1][1])
                else:
                    regions.append([a, b])
            for a, b in regions:
                for lo in range(a, b, 4 * margin):  # long regions by overlapping parts
                    near_words = got.words(lo, min(b, lo + 6 * margin))
                    share = common_subsequence(item, near_words) / len(item)
                    told = common_subsequence(answer, near_words) / len(answer)
                    if share >= settings.sure or share >= settings.likely and told >= settings.answer:
                        out[d][j] = max(out[d].get(j, (0.0,) * 4), (share, c, told, lo - begin))
        return out

    return run


def _blocks(benchmark: DataFrame, settings: Settings) -> list[DataFrame]:
    """Blocks of the items that have words, each of about `items` rows, by hash of id and text."""
    usable = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    usable = settle(usable.select(F.xxhash64("item_id", "text").alias("row"), "item_id", "text"))
    n = usable.count()
    parts = max(1, -(-2 * n // settings.items)) if n > settings.items else 1
    return [usable.where(F.pmod("row", F.lit(parts)) == k) for k in range(parts)]


def _passes(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> Iterator[Callable]:
    """For each pass over the documents a function that makes the function of texts, which gives the leaks of each text.

    A pass takes as many blocks as make `terms` rows of terms, which bounds what a task holds.
    """
    idf = weights(*document_frequency(docs, settings))
    held: list[Space] = []
    for block in _blocks(benchmark, settings):
        held.append(latent_space(block, idf, settings))
        if sum(len(s.terms) for s in held) >= settings.terms:
            yield _searches(held, idf, settings)
            held = []
    if held:
        yield _searches(held, idf, settings)


def _searches(spaces: list[Space], idf: np.ndarray, settings: Settings) -> Callable:
    def made() -> Callable[[list[str | None]], list[dict[int, tuple]]]:
        searches = [(s, search(s, idf, settings)) for s in spaces]

        def of(texts: list[str | None]) -> list[dict[int, tuple]]:
            out: list[dict[int, tuple]] = [{} for _ in texts]
            for space, one in searches:
                for i in range(0, len(texts), 256):
                    for k, hits in enumerate(one(texts[i : i + 256]), i):
                        for j, hit in hits.items():
                            out[k][space.names[j]] = max(out[k].get(space.names[j], (0.0,) * 4), hit)
            return out

        return of

    return made


LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and benchmark item that it holds: LEAKS."""
    texts, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for made in _passes(docs, benchmark, settings):
        found = texts.mapInArrow(by_text(_matches(made), PART), LEAKS)
        out = found if out is None else out.union(found)
    return out


def _matches(made: Callable):
    def step() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        of = made()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            found = zip(b.column("doc_id").to_pylist(), of(b.column("text").to_pylist()), strict=True)
            out = [(d, item, c, share, told, int(at)) for d, hits in found for item, (share, c, told, at) in hits.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"],
            )

        return run

    return step


def reject_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    out, last = docs, None
    for made in _passes(docs, benchmark, settings):
        if last is not None:  # tasks hold the searches of one pass only
            out = settle(out)

        def step(made: Callable = made) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            of = made()
            return lambda b: b.filter(pa.array([not h for h in of(b.column("text").to_pylist())], pa.bool_()))

        out = last = out.mapInArrow(by_text(step, PART), docs.schema)
    return out
