"""Token counts under a unigram model, with a trie of pre-tokens.

The model is the vocabulary of a public tokenizer file with a Zipf law over its ranks as probabilities; a
pre-token is cut into the pieces of the highest probability. Distinct pre-tokens are inserted in a trie; the
forward score of a node, the best score and the pieces of all cuts of its prefix, is computed once from the
scores of the nodes above it, so pre-tokens that begin alike share that work. Terminals hold the counts.

How it scales: one pass without a shuffle. The trie and the counts are bounded (NODES, REMEMBERED) and
start afresh when full and after each partition; pre-tokens of more than LONGEST bytes are scored without the trie.

Defined results: null and empty texts have 0 pre-tokens and 0 tokens. Of cuts with equal scores the one
of fewer pieces counts. Repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loanloom.llm.byte_bpe import PATTERN
from loanloom.llm.cluster import mapped, only
from loanloom.llm.textbatch import pieces

NODES = 400_000
REMEMBERED = 250_000
LONGEST = 256
#: Shift of the Zipf law over ranks.
SHIFT = 2.7


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_scores(path: str) -> dict[bytes, float]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {piece: -math.log(r + SHIFT) - total for piece, r in ranks.items()}


class UnigramTrie(dict):
    """Maps a pre-token (str) to its number of pieces; what it hasn't met goes through the trie."""

    _loaded: dict[str, UnigramTrie] = {}

    @classmethod
    def load(cls, path: str) -> UnigramTrie:
        if path not in cls._loaded:
            cls._loaded[path] = cls(piece_scores(path))
        return cls._loaded[path]

    def __init__(self, scores: dict[bytes, float], nodes: int = NODES):
        super().__init__()
        import regex

        self.scores, self.nodes = scores, nodes
        self.tails = {piece[k:] for piece in scores for k in range(len(piece))}  # no piece ends in anything else
        self.words = regex.compile(PATTERN).findall
        self._empty()

    def _empty(self) -> None:
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.best, self.pieces = [0.0], [0]

    def _step(self, raw: bytes, end: int, best: list[float], pieces: list[int]) -> tuple[float, int]:
        """Forward score of raw[:end] from those of its shorter prefixes."""
        top, fewest = -math.inf, 0
        start = end - 1
        while start >= 0 and (tail := raw[start:end]) in self.tails:
            if (score := self.scores.get(tail)) is not None:
                score += best[start]
                if score > top or score == top and pieces[start] + 1 < fewest:
                    top, fewest = score, pieces[start] + 1
            start -= 1
        return top, fewest

    def insert(self, raw: bytes) -> int:
        """Number of pieces of raw; its path is in the trie from now on."""
        if len(raw) > LONGEST:
            best, pieces = [0.0], [0]
            for end in range(1, len(raw) + 1):
                top, fewest = self._step(raw, end, best, pieces)
                best.append(top)
                pieces.append(fewest)
            return pieces[-1]
        if len(self.best) + len(raw) > self.nodes:
            self._empty()
        node, best, pieces = 0, [0.0], [0]
        for end, byte in enumerate(raw, 1):
            key = node << 8 | byte
            node = self.child.get(key, 0)
            if not node:
                top, fewest = self._step(raw, end, best, pieces)
                node = self.child[key] = len(self.best)
                self.best.append(top)
                self.pieces.append(fewest)
            best.append(self.best[node])
            pieces.append(self.pieces[node])
        return self.pieces[node]

    def __missing__(self, word: str) -> int:
        n = self.insert(word.encode())
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of docs."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UnigramTrie.load(path)
        for batch in pieces(batches):
            n_words, n_tokens = [], []
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                words = trie.words(text)
                n_words.append(len(words))
                n_tokens.append(sum(map(trie.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
        trie.clear()
        trie._empty()

    source = only(docs, "doc_id", "text")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", n_pretokens long, n_tokens long")
