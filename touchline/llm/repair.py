"""Token-id files compressed by Re-Pair grammars.

Documents go to ranges by ascending doc_id, and a range's ids are cut into blocks of whole documents, the shards of the method: in
each block frequent pairs of neighbouring ids are replaced by nonterminals, those of similar frequency in one round, until no pair
is frequent. A block stores its rules, the length that each rule expands to, the remaining symbols and where each document's symbols
begin, so that any document can be decoded on its own. Symbols have 16 bits each, 32 in a block whose ids and rules are more than
65,536. No rule crosses the end of a document. Blocks are rows of a Parquet table in the shared folder; a task that is run again
writes the same rows. A vocabulary of more than 65,536 ids is refused.

Defined results: null text counts as empty; every document ends with the end id, so empty ones hold one id; rows with equal ids
follow each other by text; rows without an id come first; an empty table gives no rows. A text of any length is one document of one
block, in memory in proportion to it. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm.bpe import VOCABULARY, byte_letters
from touchline.llm.common import _LETTER, COMMON, SPLIT, byte_level, gather, give_back, regrouped, settle

_STEP = np.uint32(0x9E3779B1)
_MARKS = ".,!?;:"
_SIMPLE = f"^[{_LETTER}]+[{_MARKS}]?$"
#: Pre-tokens that go to the library's model at once.
_TOGETHER = 100


@dataclass(frozen=True)
class Settings:
    end: int = 0  #: id after each document
    block: int = 1 << 20  #: ids after which a block ends with the running document
    least: int = 24  #: times that a pair must occur in a block to become a rule
    share: float = 0.25  #: pairs this share as frequent as the most frequent one are replaced in the same round
    text: int = 16 << 20  #: bytes of text that are tokenised at once, or one document
    cache: int = 160 << 20  #: bytes, about, of the space-separated chunks and their ids that a worker keeps


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


class _Letters(dict):
    """Code point -> the letters that stand for its UTF-8 bytes, for str.translate."""

    def __init__(self, of_byte: dict[int, str]):
        super().__init__()
        self.of_byte = of_byte

    def __missing__(self, point: int) -> str:
        said = self[point] = "".join(self.of_byte[b] for b in chr(point).encode("utf-8"))
        return said


class Ids:
    """Texts -> ids as the tokenizers library gives them.

    Texts of common Latin characters are cut at single spaces, where pre-tokens end, and each distinct chunk is tokenised once;
    all other texts go through the pre-tokeniser whole. Pre-tokens of chunks go to the library's model many at a time, a letter
    between them that it never merges.
    """

    def __init__(self, path: str, cache: int):
        self.split, self.cache = byte_level(path), cache
        self.model = self.split.tokenizer.model
        of_byte = {b: c for c, b in byte_letters().items()}
        self.letters = _Letters(of_byte)
        # characters beyond the common ones, special strings, and white space of two and more that holds a space
        self.uneven = "|".join([COMMON.pattern, "  ", " [\t\n\r]", "[\t\n\r] ", *map(re.escape, self.split.special)])
        self.bare = Tokenizer(self.model)  # no pre-tokeniser, no special strings
        self.said = "".join(of_byte[b] for b in range(256))
        self.border = self._border(of_byte)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = self.taken = 0
        self.table, self.at, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _border(self, of_byte: dict[int, str]) -> int | None:
        """A byte that no UTF-8 text has and whose letter is a token and part of no other; None where pieces must go one by one."""
        model, vocabulary = self.model, self.split.tokenizer.get_vocab(with_added_tokens=False)
        if model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
            return None
        merged = set().union(*(t for t in vocabulary if len(t) > 1))
        return next((b for b in (*range(0xFF, 0xF7, -1), 0xC1, 0xC0) if of_byte[b] in vocabulary and of_byte[b] not in merged), None)

    def of_piece(self, piece: str) -> list[int]:
        special = self.split.special.get(piece)
        return [t.id for t in self.model.tokenize(piece.translate(self.letters))] if special is None else [special]

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pre-tokens, none of them special, and how many each has."""
        if self.border is None:
            parts = [self.of_piece(p) for p in pieces.to_pylist()]
            return np.array([i for p in parts for i in p], np.int32), np.array([len(p) for p in parts], np.int64)
        cuts = pa.array(np.append(np.arange(0, len(pieces), _TOGETHER), len(pieces)).astype(np.int32))
        border = bytes([self.border])
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, pieces.cast(pa.binary())), pa.scalar(border, pa.binary()))
        ids: list[int] = []
        for text in joined.to_pylist():  # one text at a time: a batch would start threads beside Spark's tasks
            said = codecs.charmap_decode(text + border, "strict", self.said)[0]
            ids += self.bare.encode_batch_fast([said], add_special_tokens=False)[0].ids
        flat = np.array(ids, np.int32)
        inner = flat != self.bare.token_to_id(self.said[self.border])
        ends = np.flatnonzero(~inner) - np.arange(len(pieces))  # in the ids without borders
        return flat[inner], np.diff(ends, prepend=0)

    def _learn(self, chunks: pa.Array) -> None:
        """Tokenise chunks that are not known yet; one follows a blank or, where a zero opens it, begins its text."""
        pieces = {m: k for k, m in enumerate(_MARKS)}
        simple = pc.match_substring_regex(chunks, _SIMPLE)  # letters are one piece, a mark after them another
        order, sizes, findall, number = [], [], SPLIT.findall, pieces.setdefault
        for chunk in chunks.filter(pc.invert(simple)).to_numpy(zero_copy_only=False).tolist():
            found = findall(chunk[1:] if chunk[:1] == "\0" else " " + chunk)
            order += [number(p, len(pieces)) for p in found]
            sizes.append(len(found))
        simple, chosen = simple.to_numpy(zero_copy_only=False), chunks.filter(simple)
        bare = pc.utf8_rtrim(chosen, _MARKS)
        marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(chosen))
        marks = pc.index_in(pc.utf8_slice_codeunits(chosen.filter(marked), -1), pa.array(list(_MARKS))).to_numpy()
        marked, words = marked.to_numpy(zero_copy_only=False), bare.dictionary_encode()
        size = np.empty(len(chunks), np.int64)
        size[simple], size[~simple] = 1 + marked, sizes
        first = np.cumsum(size) - size
        which = np.empty(int(size.sum()), np.int64)  # the pieces of all chunks
        which[first[simple]] = words.indices.to_numpy() + len(pieces)
        which[first[simple][marked] + 1] = marks
        which[gather(first[~simple], size[~simple])] = order
        after_blank = pc.binary_join_element_wise(" ", words.dictionary, "")
        ids, count = self.of_pieces(pa.concat_arrays([pa.array(list(pieces), pa.string()), after_blank]))
        known = ids[gather((np.cumsum(count) - count)[which], count[which])]
        ends = np.concatenate(([0], np.cumsum(count[which])))
        n, new = len(self.known), ends[first + size] - ends[first]
        self.known = pa.concat_arrays([self.known, chunks])
        self.count, self.at = (_room(x, n + len(new)) for x in (self.count, self.at))
        self.table = _room(self.table, self.ids + len(known))
        self.count[n : n + len(new)] = new
        self.at[n : n + len(new)] = np.cumsum(new) - new + self.ids
        self.table[self.ids : self.ids + len(known)] = known
        self.ids += len(known)
        self.taken += 2 * (pc.sum(pc.binary_length(chunks)).as_py() or 0) + 64 * len(chunks) + 4 * len(known)  # looking up takes as much again

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts without nulls and how many each has."""
        if self.taken > self.cache:
            self.clear()
        uneven = pc.match_substring_regex(texts, self.uneven)
        slow = {k: texts[k].as_py() for k in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist()}
        opened = pc.binary_join_element_wise("\0", pc.if_else(uneven, "", texts), "")
        chunks = pc.split_pattern(opened, " ")
        coded = chunks.values.dictionary_encode()
        seen = pc.index_in(coded.dictionary, value_set=self.known)
        if seen.null_count:
            first, new = len(self.known), seen.is_null()
            self._learn(coded.dictionary.filter(new))
            seen, new = seen.fill_null(0).to_numpy().copy(), new.to_numpy(zero_copy_only=False)
            seen[new] = np.arange(first, len(self.known))
        which = np.asarray(seen)[coded.indices.to_numpy()]
        lengths = self.count[which]
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.empty(int(cuts[-1]), np.int32)
        for i in range(0, len(which), 1 << 16):
            j = min(i + (1 << 16), len(which))
            ids[cuts[i] : cuts[j]] = self.table[gather(self.at[which[i:j]], lengths[i:j])]
        ends = cuts[chunks.offsets.to_numpy()]
        if not slow:
            return ids, np.diff(ends)
        slow = {k: np.array([i for p in self.split.pieces(t) for i in self.of_piece(p)], np.int32) for k, t in slow.items()}
        parts = [slow.get(k, ids[ends[k] : ends[k + 1]]) for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts])


def _apart(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places are replaced, so that no two overlap: of neighbours the more frequent one, of equally
    frequent ones every other from the left."""
    follows = np.concatenate(([False], at[1:] == at[:-1] + 1))  # overlaps the pair before
    leads = np.concatenate((follows[1:], [False]))
    before, after = np.concatenate(([0], weight[:-1])) * follows, np.concatenate((weight[1:], [0])) * leads
    out = (weight > before) & (weight >= after)
    taken = np.concatenate(([False], out[:-1])) & follows | np.concatenate((out[1:], [False])) & leads
    rest = np.flatnonzero(~out & ~taken)
    if len(rest):
        place = np.arange(len(rest))
        head = np.concatenate(([True], at[rest[1:]] != at[rest[:-1]] + 1))
        out[rest[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]] = True
    return out


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint64:
        keys = (keys ^ keys >> np.uint64(27)).astype(np.uint32)
    return (keys * _STEP >> np.uint32(12)).astype(np.int64)


def _kind(symbols: int) -> type:
    """The type of a block's symbols: 16 bits while they suffice."""
    return np.uint16 if symbols <= 1 << 16 else np.uint32


def grammar(ids: np.ndarray, last: np.ndarray, base: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n x 2, nonterminals count from base), the remaining symbols, and which of them end a document.

    A round counts all pairs exactly and replaces those that occur at least `share` times as often as the most frequent one; the
    last round finds no pair that occurs `least` times. A block with more rules than 16-bit numbers goes on with symbols of 32 bits.
    A pair that is rare stays rare, since new neighbours are new symbols: its places are counted again only when one is replaced.
    """
    symbols, last, rules, made = ids.astype(np.uint32), last.copy(), [], 0
    live = ~last  # places of the pairs that may be frequent
    live[-1:] = False
    while True:
        place = np.flatnonzero(live)
        if len(place) < max(settings.least, 1):
            break
        kind, half = (np.uint32, 16) if base + made <= 1 << 16 else (np.uint64, 32)
        half = kind(half)
        key = symbols[place].astype(kind, copy=False) << half | symbols[place + 1].astype(kind, copy=False)
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        counts = np.diff(edge)
        often = np.flatnonzero(counts >= settings.least)
        if not len(often):
            break
        keys, counts = ordered[edge[often]], counts[often]
        sieve = np.zeros(1 << 20, np.uint8)
        sieve[_slot(keys)] = 1
        pick = counts >= settings.share * counts.max()
        keys, counts = keys[pick], counts[pick]
        sieve[_slot(keys)] = 2
        mark = sieve[_slot(key)]
        live[place] = mark > 0
        found = np.flatnonzero(mark == 2)
        at, key = place[found], key[found]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[k] == key
        at, k = at[hit], k[hit]
        chosen = _apart(at, counts[k])
        at, k = at[chosen], k[chosen]
        useful = np.bincount(k, minlength=len(keys)) > 1  # a rule for one place would not pay
        at, k = at[useful[k]], k[useful[k]]
        number = np.cumsum(useful) - 1 + base + made
        rules.append(np.stack([keys[useful] >> half, keys[useful] & (kind(1) << half) - kind(1)], axis=1).astype(np.uint32))
        made += int(useful.sum())
        symbols[at] = number[k].astype(np.uint32)
        last[at] = last[at + 1]
        for changed in (at, at[at > 0] - 1):
            live[changed] = ~last[changed]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        symbols, last, live = symbols[stay], last[stay], live[stay]
        live[-1:] = False
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), symbols.astype(_kind(base + made)), last


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table of the ids of all symbols with where each symbol's begin and how many they are."""
    count = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
    at = np.cumsum(count) - count
    table = np.zeros(int(count.sum()), np.uint32)
    table[:base] = np.arange(base)
    done = 0
    while done < len(rules):  # all rules whose sides are known at once
        limit = base + done
        more = done + int(np.argmin(np.append((rules[done:] < limit).all(axis=1), False)))
        sides = rules[done:more].astype(np.int64).ravel()
        table[at[base + done] : at[base + more - 1] + count[base + more - 1]] = table[gather(at[sides], count[sides])]
        done = more
    return table, at, count


BLOCKS = (
    "shard long, before long, base int, doc_ids array<long>, starts binary, rules binary, lengths binary, symbols binary, "
    "n_docs long, n_tokens long"
)


def compress(docs: DataFrame, settings: Settings = Settings(), path: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the documents' ids as grammar-compressed blocks, shards ascending by doc_id; returns the table of blocks."""
    path = path or public_tokenizers.path(VOCABULARY)
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shard, before = Ids(path, settings.cache), TaskContext.get().partitionId(), 0
        base = of.split.tokenizer.get_vocab_size()
        if max(base, settings.end + 1) > 1 << 16:
            raise ValueError(f"{base} ids do not fit into 16 bits")
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush() -> pa.RecordBatch:
            nonlocal before
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes) - 1] = True
            rules, symbols, ends = grammar(ids, last, base, settings)
            count = np.ones(base + len(rules), np.uint32)
            for k, (a, b) in enumerate(rules.tolist()):
                count[base + k] = count[a] + count[b]
            starts = np.concatenate(([0], np.flatnonzero(ends) + 1)).astype(np.uint32)
            row = {
                "shard": [shard], "before": [before], "base": [base], "doc_ids": [[d for h in held for d in h[2]]],
                "starts": [starts.tobytes()], "rules": [rules.tobytes()], "lengths": [count[base:].tobytes()],
                "symbols": [symbols.tobytes()], "n_docs": [len(sizes)], "n_tokens": [len(ids)],
            }
            before += len(ids)
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=kinds)

        total = 0
        for part in regrouped(batches, settings.text):
            ids, sizes = of.many(part.column("text"))
            out = np.full(len(ids) + len(sizes), settings.end, np.int32)
            inner = np.ones(len(out), bool)
            inner[np.cumsum(sizes + 1) - 1] = False
            out[inner] = ids
            docs, ends, row = part.column("doc_id").to_pylist(), np.concatenate(([0], np.cumsum(sizes + 1))), 0
            while row < len(docs):  # up to the document that fills the block
                end = min(int(np.searchsorted(ends, ends[row] + settings.block - total)), len(docs))
                held.append((out[ends[row] : ends[end]], sizes[row:end] + 1, docs[row:end]))
                total += int(ends[end] - ends[row])
                row = end
                if total >= settings.block:
                    yield flush()
                    total = 0
        if held:
            yield flush()
        of.clear()
        give_back()

    kinds = pa.schema(
        [("shard", pa.int64()), ("before", pa.int64()), ("base", pa.int32()), ("doc_ids", pa.list_(pa.int64()))]
        + [(n, pa.binary()) for n in ("starts", "rules", "lengths", "symbols")]
        + [("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    )
    ranges = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return settle(ranges.mapInArrow(run, BLOCKS))


def read(blocks: DataFrame) -> DataFrame:
    """Documents from the blocks: doc_id, start (ids of all documents before), n_tokens, ids (uint32 as bytes)."""
    return blocks.mapInArrow(_decoder(_before(blocks), False), "doc_id long, start long, n_tokens long, ids binary")


def _before(blocks: DataFrame) -> dict[int, int]:
    """Ids in all shards before a shard; one row for each shard comes to the driver."""
    out, n = {}, 0
    for shard, tokens in sorted(blocks.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        out[shard] = n
        n += tokens
    return out


def _decoder(before: dict[int, int], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rules = np.frombuffer(r["rules"], np.uint32).reshape(-1, 2)
                table, at, count = expansions(rules, np.frombuffer(r["lengths"], np.uint32), r["base"])
                symbols = np.frombuffer(r["symbols"], _kind(r["base"] + len(rules))).astype(np.int64)
                starts = np.frombuffer(r["starts"], np.uint32).astype(np.int64)
                ids = table[gather(at[symbols], count[symbols])].astype("<u4")
                cuts = np.concatenate(([0], np.cumsum(count[symbols])))[starts]
                raw = memoryview(ids.tobytes())
                pieces = [raw[4 * i : 4 * j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                start = cuts[:-1] + before[r["shard"]] + r["before"]
                last = pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digest else pa.array([bytes(p) for p in pieces], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(np.diff(cuts)), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def one_document(block: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a block, decoded without the others."""
    starts = np.frombuffer(block["starts"], np.uint32)
    rules, base, out = np.frombuffer(block["rules"], np.uint32).reshape(-1, 2), block["base"], []
    symbols = np.frombuffer(block["symbols"], _kind(base + len(rules)))[starts[k] : starts[k + 1]]
    work = symbols[::-1].tolist()
    while work:
        s = work.pop()
        if s < base:
            out.append(s)
        else:
            work += [int(rules[s - base][1]), int(rules[s - base][0])]
    return np.array(out, np.uint32)


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    blocks = compress(docs, settings)
    return blocks.mapInArrow(_decoder(_before(blocks), True), "doc_id long, start long, n_tokens long, ids_crc32 long")
