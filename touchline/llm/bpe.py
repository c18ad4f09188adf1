"""Byte-level BPE by backtracking over longest matches, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token that starts at each byte of a pre-token. Tokens are taken
greedily; a token is kept only if it is compatible with the one before it, that is, if merging by rank would not have joined
across their border, and otherwise gives way to its longest shorter prefix token or to the step before it. A bit per byte marks
positions that led nowhere, so the work is linear. The ids are those of the merge procedure itself.

Defined results: null text counts as empty; empty text has no ids; one output row per input row, so repeated rows repeat and an
empty table gives none; a text of any length is encoded whole, in memory in proportion to it; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import CACHE_BYTES, ByteLevel, by_text, gather

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the pair-compatibility table that are kept before it starts afresh.
PAIRS = 1 << 18


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Backtracking:
    """Encoder and decoder of one vocabulary file; cheap to build once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.split = ByteLevel(path)
        letters = byte_letters()
        vocabulary = model["vocab"]
        raw = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        single = len(vocabulary)
        self.pair: dict[tuple[int, int], int] = {}  # two tokens -> the token they merge to
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for order, (a, b) in enumerate(merges):
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.pair[left, right] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), order + single
        for i, b in raw.items():
            if len(b) == 1:
                self.parts[i], self.rank[i] = (i, i), i
        self.raw = {i: b for i, b in raw.items() if i in self.parts}
        self.size = {i: len(b) for i, b in self.raw.items()}
        ids = {b: i for i, b in self.raw.items()}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
            self.shorter[i] = next((ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ids), None)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # two tokens as one number
        flat = {**self.raw, **{i: s.encode() for s, i in self.split.special.items()}}
        self.lengths = np.zeros(max(flat) + 1, np.int64)
        for i, b in flat.items():
            self.lengths[i] = len(b)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(flat[i] for i in sorted(flat)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the border between tokens a and b: no pair across it merges before its sides are made."""
        known = self.fits.get(a << 32 | b)
        if known is not None:
            return known
        left, right, limit, out = a, b, 1 << 60, True
        while True:
            whole = self.pair.get((left, right))
            if whole is not None and self.rank[whole] < limit:
                out = False
                break
            # undo the later of the two tokens' merges; on the left side ties count as earlier
            if self.rank[left] > self.rank[right]:
                limit = self.rank[left]
                step = self.parts[left][1]
                if step == left:
                    break
                left = step
            else:
                limit = self.rank[right] + 1
                step = self.parts[right][0]
                if step == right:
                    if self.parts[left][1] == left:
                        break
                    limit = self.rank[left]
                    left = self.parts[left][1]
                else:
                    right = step
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[a << 32 | b] = out
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        special = self.split.special.get(piece)
        if special is not None:
            return [special]
        text = piece.encode("utf-8").decode("latin-1")
        n = len(text)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(text):
            longest[end - size + 1] = token  # ends only grow
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + self.size[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            less = self.shorter[token]
            if less is None:
                alive[at] = 0
                token = out.pop()
                at -= self.size[token]
            else:
                token = less
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes[gather(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


class Encoded:
    """Pre-token -> (number, ids as text); the ids themselves stand in one growing table."""

    def __init__(self, encoder: Backtracking):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.end = self.taken = 0

    def add(self, piece: str) -> None:
        ids = self.encoder.encode_piece(piece)
        k = len(self.said)
        if k == len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.count))
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.at[k], self.count[k] = self.end, len(ids)
        self.ids[self.end : self.end + len(ids)] = ids
        self.end += len(ids)
        self.number[piece] = k
        self.said.append(",".join(map(str, ids)))
        self.taken += sys.getsizeof(piece) + len(self.said[-1]) + 4 * len(ids) + 200

    def __call__(self, text: str) -> tuple[np.ndarray, str]:
        """All ids of a text, as an array and as decimal numbers joined by commas."""
        pieces = self.encoder.split.pieces(text)
        if self.taken > CACHE_BYTES:
            self.clear()
        for piece in set(pieces).difference(self.number):
            self.add(piece)
        which = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        ids = self.ids[gather(self.at[which], self.count[which])]
        return ids, ",".join(map(self.said.__getitem__, which.tolist()))


@functools.cache
def _built(path: str) -> Backtracking:
    """The automaton of a vocabulary file, of a fixed size, built once in a Python worker."""
    return Backtracking(path)


def encoder(path: str) -> Encoded:
    """An encoder of a vocabulary file; the words and pairs that it keeps go with it."""
    out = Encoded(_built(path))
    out.encoder.fits = {}
    return out


def encode(docs: DataFrame, path: str | None = None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """The ids of every document as an array: doc_id, ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def step() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        of = encoder(path)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [of(t or "")[0] for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return run

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_text(step), schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids) back to doc_id, text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _built(path)
        for b in batches:
            texts = [table.decode(np.asarray(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every document in one pass: DIGESTS."""
    path = path or public_tokenizers.path(VOCABULARY)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def step() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        of = encoder(path)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids, texts = [], [], []
            for t in b.column("text").to_pylist():
                array, said = of(t or "")
                counts.append(len(array))
                ids.append(sha(said))
                texts.append(sha(of.encoder.decode(array)))
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return run

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_text(step), DIGESTS)
