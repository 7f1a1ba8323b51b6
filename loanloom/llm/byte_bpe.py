"""Byte-level BPE encoding and decoding with a public vocabulary file.

A pre-token is a contiguous array of parts with the ranks of adjacent pairs beside it: the smallest rank
is looked up again and again, its boundary is deleted, and the two neighbouring ranks are refreshed. That
is quick for short words; pre-tokens of more than SHORT bytes keep the pairs in a heap instead. Pre-tokens
that were met before come from a bounded dictionary, cleared when full and after each partition. No shuffle;
memory is a batch of bounded bytes.

Defined results: null text is empty; an empty text has no ids. The string of a special token in a text
becomes that token. Ids are one binary value, little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loanloom.llm.cluster import mapped, only
from loanloom.llm.textbatch import pieces, release

SHORT = 256
#: Pre-tokens that a Python worker remembers.
REMEMBERED = 250_000
NEVER = 1 << 30
#: The pre-token pattern of the vocabulary, with Unicode white space written out.
SPACES = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % ((SPACES,) * 4)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bpe(dict):
    """Maps a pre-token (str) to the bytes of its ids; learns what it is asked."""

    _loaded: dict[str, Bpe] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
            release()  # of what reading the file took
        return cls._loaded[path]

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, vocab = _byte_letters(), content["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, n in vocab.items():
            if token not in self.special:
                self.bytes_of[n] = bytes(letters[c] for c in token)
        for token, n in self.special.items():
            self.bytes_of[n] = token.encode()
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, merge in enumerate(content["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[a] << 20 | vocab[b]] = k
            self.made.append(vocab[a + b])
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.short(raw) if len(raw) <= SHORT else self.long(raw)
        out = b"".join(x.to_bytes(4, "little") for x in ids)
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def short(self, raw: bytes) -> list[int]:
        parts = [self.single[b] for b in raw]
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], NEVER)
        return parts

    def long(self, raw: bytes) -> list[int]:
        """The same merges with a heap of pairs (rank, left place) and links between the parts left."""
        parts: list[int | None] = [self.single[b] for b in raw]
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or rank.get(parts[i] << 20 | parts[j]) != r:
                continue
            parts[i], parts[j] = self.made[r], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank.get(parts[i] << 20 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank.get(parts[before[i]] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (x, before[i]))
        return [x for x in parts if x is not None]

    def encode(self, text: str) -> bytes:
        known = self.__getitem__
        if self.cut is None or not any(x in text for x in self.special):
            return b"".join(map(known, self.words(text)))
        out = []
        for piece in self.cut(text):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            else:
                out.extend(map(known, self.words(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def _forgetting(bpe: Bpe, batches: Iterator[pa.RecordBatch], each: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """each of the pieces of batches; the words remembered go with the partition, the vocabulary stays."""
    try:
        yield from map(each, pieces(batches))
    finally:
        bpe.clear()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (binary) of every text of docs."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bpe.encode, texts), pa.binary())], ["doc_id", "ids"])

        return _forgetting(bpe, batches, each)

    source = only(docs, "doc_id", "text")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pc.fill_null(batch.column(1), b"").to_pylist()
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "text"])

        return _forgetting(bpe, batches, each)

    source = only(encoded, "doc_id", "ids")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", ids binary, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of every text of docs: encode() and decode() in one pass, so that a task
    holds one vocabulary and the ids stay in its worker."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(text) for text in pc.fill_null(batch.column(1), "").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "text"])

        return _forgetting(bpe, batches, each)

    source = only(docs, "doc_id", "text")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", ids binary, text string")
