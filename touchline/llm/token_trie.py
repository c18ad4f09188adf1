"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are the words between white space, opened by the word mark. Under a unigram model over a public vocabulary (a piece
of rank r has probability in proportion to 1 / (r + 10)) the best segmentation of every prefix is computed once, when its trie
node is made, and shared by all words with that prefix; a word's terminal holds its number of tokens. Characters without a
piece fall back to their UTF-8 bytes. Each Python worker grows its own trie and starts afresh beyond `Settings.nodes`; counts do
not depend on that.

Defined results: null, empty and blank texts have no words and no tokens; one output row per input row, so repeated rows repeat and
an empty table gives none; a text of any length is counted whole; of segmentations of equal score the one of fewest tokens counts;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import by_text

MARK = "▁"


@dataclass(frozen=True)
class Settings:
    vocabulary: str = "piece_bpe_32k.model"
    nodes: int = 1_200_000  #: trie nodes that a worker keeps at most
    words: int = 800_000  #: words whose counts it keeps at most
    shift: int = 10


def scores(path: str, shift: int) -> dict[str, float]:
    """Log-probability of each ordinary piece, by its rank in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    whole = math.log(sum(1 / (r + shift) for r in range(len(usual))))
    return {model.id_to_piece(i): -math.log(r + shift) - whole for r, i in enumerate(usual)}


class Trie(dict):
    """Word -> number of tokens; a missing word is inserted, scoring only the nodes that are new."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) - 1  # a byte is rarer than any piece
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def __missing__(self, word: str) -> int:
        text, node, path = MARK + word, 0, [0]
        for depth, c in enumerate(text, 1):
            node = self.child.get((node, c), -1)
            if node < 0:
                node = self.extend(path, text, depth)
            path.append(node)
        self[word] = count = self.tokens[node]
        return count

    def extend(self, path: list[int], text: str, depth: int) -> int:
        """A new node for text[:depth]: the best of all last pieces; of equal scores, the fewest tokens."""
        c = text[depth - 1]
        width = len(c.encode("utf-8", "surrogatepass"))
        before = path[depth - 1]
        best, tokens = self.best[before] + width * self.byte, self.tokens[before] + width
        for n in range(1, min(depth, self.longest) + 1):
            own = self.scores.get(text[depth - n : depth])
            if own is not None:
                before = path[depth - n]
                score, count = self.best[before] + own, self.tokens[before] + 1
                if score > best or score == best and count < tokens:
                    best, tokens = score, count
        self.best.append(best)
        self.tokens.append(tokens)
        self.child[path[depth - 1], c] = len(self.best) - 1
        return len(self.best) - 1


def counted(rows: DataFrame, settings: Settings = Settings(), path: str | None = None) -> DataFrame:
    """The rows with n_words and n_tokens in place of their text."""
    path = path or public_tokenizers.path(settings.vocabulary)

    def step():
        trie = Trie(scores(path, settings.shift))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            words, tokens = [], []
            for t in b.column("text").to_pylist():
                if len(trie) > settings.words or len(trie.best) > settings.nodes:
                    trie.restart()
                w = (t or "").split()
                words.append(len(w))
                tokens.append(sum(map(trie.__getitem__, w)))
            return pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=[*carried, "n_words", "n_tokens"],
            )

        return run

    carried = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(by_text(step), f"{kinds}, n_words long, n_tokens long")


def token_counts(docs: DataFrame, settings: Settings = Settings(), path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    return counted(docs.select(F.col("doc_id").cast("long"), "text"), settings, path)


def totals(docs: DataFrame, column: str, settings: Settings = Settings(), path: str | None = None) -> DataFrame:
    """Documents, words and tokens by a column of the documents; counts are summed before they are shuffled."""
    rows = counted(docs.select(F.col(column).alias("doc_key"), "text"), settings, path)
    return rows.groupBy(F.col("doc_key").alias(column)).agg(
        F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens")
    )
