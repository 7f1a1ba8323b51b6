"""Line dedup with a sharded minimal perfect hash.

All distinct line keys (128-bit digests) are dealt to shards. Each shard builds a minimal perfect hash
over its keys; it indexes arrays of 32-bit fingerprints, document counts (saturating at 255) and the
smallest doc_id. Documents then send the digests of their lines to the shards, which probe the arrays
and answer with the lines to drop; lines themselves are never joined.

How it scales: what a batch of documents knows about a key is aggregated before the shuffle, so that a
line that stands in a third of all documents sends one row per batch. Keys in more than 1/HOT_SHARE of
all line entries, of which there can't be more than HOT_SHARE by counting, skip the shards: they are
broadcast, and every other key has few requests. The number of shards follows the number of documents.

Defined results: a line's key is the line stripped of \\x20 and \\x09-\\x0D, with A-Z lower-cased. Keys
of at least min_chars code points found under at least two doc_ids lose their lines everywhere but in the
smallest doc_id. Null or empty text is one empty line. A row without doc_id neither counts nor loses
lines. Rows that repeat a doc_id are one document. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.cluster import mapped, only, written
from loanloom.llm.textbatch import mixed

STRIPPED = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: At most so many keys are broadcast.
HOT_SHARE = 100_000
#: Keys in a batch's hot list have at least so many documents.
HOT_LEAST = 64
#: Documents per shard; at some tens of lines each, a shard has tens of thousands of keys.
DOCS_PER_SHARD = 1024
#: Dropped lines up to this many bytes of digests are broadcast to the documents; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(STRIPPED).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def _digests(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h1, h2 and doc_id of the distinct keys of each document of a batch (doc_id, text)."""
    found, ids = [], []
    for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
        if doc_id is not None:
            keys = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
            found.extend(keys)
            ids.extend([doc_id] * len(keys))
    pairs = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy(), np.array(ids, np.int64)


class MinimalPerfectHash:
    """Levels of bit arrays: a key goes to the first level where no other key of that level has its
    place; its number is the count of bits before it. What is left after the last level is a sorted list."""

    LEVELS, ROOM = 24, 1.7

    def __init__(self, sizes: list[int], bits: bytes, rest: bytes):
        self.sizes, self.rest = sizes, np.frombuffer(rest, np.uint64)
        self.packed = bits
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(sizes)].astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct 64-bit values."""
        sizes, levels = [], []
        for level in range(cls.LEVELS):
            if not len(keys):
                break
            size = max(8, int(len(keys) * cls.ROOM))
            at = cls.place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(sizes, np.packbits(bits).tobytes(), np.sort(keys).tobytes())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys that it was built on; of others -1 or any number."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = self.place(keys[left], level, size) + base
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]] - 1
            left, base = left[~hit], base + size
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = (self.rank[-1] if len(self.rank) else 0) + at[hit]
        return out


def _one(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mixed(h1.view(np.uint64)) + h2.view(np.uint64)


INDEX = "shard int, n long, entries long, sizes array<int>, bits binary, rest binary, fingerprints binary, counts binary, first_ids binary, hot array<struct<h1: long, h2: long, n: long, first: long>>"


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per shard: the minimal perfect hash, its arrays and the shard's frequent keys."""
    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = max(1, -(-docs.count() // DOCS_PER_SHARD))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids = _digests(batch, min_chars)
            order = np.lexsort((ids, h2, h1))
            h1, h2, ids = h1[order], h2[order], ids[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(h1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[at], h2[at], (ends - at).astype(np.int64), ids[at], ids[ends - 1] if len(at) else ids[:0])], ["h1", "h2", "n", "first", "last"])

    keys = mapped(source, known, "h1 long, h2 long, n long, first long, last long")
    keys = keys.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).repartition(F.col("shard"))
    keys = keys.groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))

    def build(table: pa.Table) -> pa.Table:
        h1, h2, n, first, last = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "first", "last"))
        one = _one(h1, h2)
        n = np.where(first == last, 1, np.maximum(n, 2))  # one document, however many rows it has
        index = MinimalPerfectHash.build(np.unique(one))
        at = index(one)
        prints, counts, ids = np.zeros(len(one), np.uint32), np.zeros(len(one), np.uint8), np.zeros(len(one), np.int64)
        prints[at], counts[at], ids[at] = h2.view(np.uint64) >> np.uint64(32), np.minimum(n, 255), first
        hot = [{"h1": int(a), "h2": int(b), "n": int(c), "first": int(d)} for a, b, c, d in zip(*(x[n >= HOT_LEAST] for x in (h1, h2, n, first)), strict=True)]
        row = {"shard": table.column("shard")[0].as_py(), "n": len(one), "entries": int(n.sum()), "sizes": index.sizes, "bits": index.packed, "rest": index.rest.tobytes(), "fingerprints": prints.tobytes(), "counts": counts.tobytes(), "first_ids": ids.tobytes(), "hot": hot}
        return pa.Table.from_pylist([row], schema=_INDEX_ARROW)

    return written(keys.groupBy("shard").applyInArrow(build, INDEX), "line-index")


_HOT_ARROW = pa.struct([(c, pa.int64()) for c in ("h1", "h2", "n", "first")])
_INDEX_ARROW = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("entries", pa.int64()), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("bits", "rest", "fingerprints", "counts", "first_ids")), ("hot", pa.list_(_HOT_ARROW))])


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the kept lines as text and two more columns at the end, the numbers of lines before
    dropping and of lines dropped: n_lines and n_dropped, with _ added while a column has that name."""
    spark = docs.sparkSession
    index = build_index(docs, min_chars)
    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    total = index.agg(F.sum("n").alias("n"), F.sum("entries").alias("entries")).first()
    shards = max(1, -(-docs.count() // DOCS_PER_SHARD))
    limit = max(HOT_LEAST, (total["entries"] or 0) // HOT_SHARE)
    hot_rows = index.select(F.explode("hot").alias("x")).select("x.*").where(F.col("n") > limit).collect()
    hot = spark.sparkContext.broadcast({(r["h1"], r["h2"]): r["first"] for r in hot_rows})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(sorted(a for a, _ in hot.value), np.int64)
        for batch in batches:
            h1, h2, ids = _digests(batch, min_chars)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h1), len(frequent) - 1)
                maybe = np.flatnonzero(frequent[at] == h1)
                stay = np.ones(len(h1), bool)
                stay[[i for i in maybe if (int(h1[i]), int(h2[i])) in hot.value]] = False
                h1, h2, ids = h1[stay], h2[stay], ids[stay]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, ids)], ["h1", "h2", "doc_id"])

    asked = mapped(source, ask, "h1 long, h2 long, doc_id long").withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int"))

    def probe(requests: pa.Table, arrays: pa.Table) -> pa.Table:
        h1, h2, ids = (requests.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        if not len(h1) or not arrays.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64())})
        row = arrays.to_pylist()[0]
        at = MinimalPerfectHash(row["sizes"], row["bits"], row["rest"])(_one(h1, h2))
        prints, counts, first = np.frombuffer(row["fingerprints"], np.uint32), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["first_ids"], np.int64)
        drop = (at >= 0) & (prints[at] == h2.view(np.uint64) >> np.uint64(32)) & (counts[at] > 1) & (first[at] != ids)
        return pa.table({"id": ids[drop], "h1": h1[drop]})

    arrays = index.select("shard", "sizes", "bits", "rest", "fingerprints", "counts", "first_ids")
    drops = asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(probe, "id long, h1 long")
    drops = written(drops, "line-drops")
    lists = drops.groupBy("id").agg(F.collect_list("h1").alias("h1s"))
    near = F.broadcast(lists) if drops.count() * 16 <= BROADCAST_BYTES else lists

    names = [*docs.columns]
    for wanted in ("n_lines", "n_dropped"):
        while wanted in names:
            wanted += "_"
        names.append(wanted)
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    with_lists = docs.join(near, docs["doc_id"].cast("long") == near["id"], "left").select(*[docs[c] for c in docs.columns], near["h1s"])

    def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = {(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True)): first for (a, b), first in hot.value.items()}
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            texts, was_null = _texts(batch.column(text_at)), batch.column(text_at).is_null().to_pylist()
            for doc_id, text, null, digests in zip(batch.column(id_at).to_pylist(), texts, was_null, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if doc_id is not None and (digests or frequent):
                    own = {x.to_bytes(8, "little", signed=True) for x in digests or ()}
                    stay = []
                    for line in lines:
                        key = line_key(line, min_chars)
                        if key is None or key[:8] not in own and frequent.get(key, doc_id) == doc_id:
                            stay.append(line)
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(text if len(stay) == len(lines) else b"\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept.append(text)
                if null:
                    kept[-1] = None
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    schema = docs.schema
    for name in names[len(docs.columns) :]:
        schema = schema.add(name, "long")
    return mapped(with_lists, drop_lines, schema)
