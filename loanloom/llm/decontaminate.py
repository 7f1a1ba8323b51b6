"""Benchmark decontamination with spaced seeds.

Words are lower-cased runs of letters and digits (of any script; curly quotes, dashes and the like end a word). A seed is a fixed mask over word positions: the hash of
the words at its ones, whatever stands at its zeros. The seeds of all places of the benchmark are held as a
sorted array with a bitmap in front; every place of every document is looked up. Around each hit the document
and the item are compared word by word along the hit's diagonal, and the best stretch counts (a match
scores 1, a substitution -SUBSTITUTION): the document is contaminated by the item when that stretch
holds at least min_matched equal words, or share_of_item of a shorter item.

How it scales: one pass over the documents, no shuffle. The benchmark is taken in chunks of about CHUNK items
and CHUNK_BYTES of text (by a hash), each sent to the executors by itself, so memory is bounded however long it
is; each chunk is one more pass. Within a block of texts, places that give a hit on one diagonal count once.

Defined results: null or empty texts and items match nothing. Of several stretches of one item in a
document the one with most equal words counts, the first on a tie. Items of fewer words than the shortest
mask spans, or as many, have runs of as many words as they need for seeds. Repeated items count once for each item_id; repeated rows of docs stay repeated. item_id keeps its type. An empty
table of documents or items gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loanloom.llm import textbatch
from loanloom.llm.cluster import mapped, only

#: Six words each. Any of them alone survives a substitution of every fifth word.
MASKS = ("11101011", "110110101", "1011010011")
STEPS = tuple(tuple(i for i, x in enumerate(m) if x == "1") for m in MASKS)
#: Words that the shortest mask spans.
SHORTEST = min(map(len, MASKS))
SUBSTITUTION = 3
MIN_MATCHED = 10
SHARE_OF_ITEM = 0.8
#: Benchmark items, and bytes of their texts, that one pass looks for.
CHUNK = 20_000
CHUNK_BYTES = 16 << 20
_BITS = 22


def folded(column: pa.Array) -> pa.Array:
    """Texts in lower case, with a space for whatever isn't a letter, mark, number or space. ASCII texts stay as
    they are: the hashes of words fold those."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    plain = pc.fill_null(pc.string_is_ascii(column), True) if len(column) else pa.array([], pa.bool_())
    if pc.all(plain).as_py() in (True, None):
        return column
    other = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{M}\p{N}\s]+", " ")
    return pc.if_else(plain, column, other)


class SeedIndex:
    """The seeds of a bounded set of items."""

    def __init__(self, ids: list, texts: list[str | None], min_matched: int, share: float):
        hashes, first = [], [0]
        for _, data, offsets in textbatch.blocks(folded(pa.array(texts, pa.large_string()))):
            h, f = textbatch.word_hashes(data, offsets, gap=textbatch.PUNCTUATION)
            hashes.append(h)
            first.extend((f[1:] + first[-1]).tolist())
        self.ids, self.words = ids, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.array(first)
        owner = np.repeat(np.arange(len(ids)), np.diff(self.first))
        seeds, items, places = [], [], []
        for steps in STEPS:
            seed = textbatch.joined(self.words, steps)
            inside = owner[: len(seed)] == owner[steps[-1] :]
            at = np.flatnonzero(inside)
            seeds.append(seed[at])
            items.append(owner[at])
            places.append(at - self.first[owner[at]])
        # in items no longer than the shortest mask no stretch gains by a substitution: equal words are one run
        sizes = np.diff(self.first)
        run = np.where(sizes <= SHORTEST, np.ceil(np.minimum(min_matched, share * sizes)), 0).astype(np.int64)
        self.runs = [tuple(range(n)) for n in np.unique(run).tolist() if n > 0]
        for steps in self.runs:
            seed = textbatch.joined(self.words, steps)
            inside = (owner[: len(seed)] == owner[steps[-1] :]) & (run[owner[: len(seed)]] == len(steps))
            at = np.flatnonzero(inside)
            seeds.append(seed[at])
            items.append(owner[at])
            places.append(at - self.first[owner[at]])
        seeds, items, places = np.concatenate(seeds), np.concatenate(items), np.concatenate(places)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.items, self.places = seeds[order], items[order], places[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, place of the item's first word in the text) of all hits in a block of texts."""
        found: set[tuple[int, int, int]] = set()
        if not len(self.seeds):
            return found
        for steps in (*STEPS, *self.runs):
            seed = textbatch.joined(words, steps)
            at = np.flatnonzero(self.bitmap[(seed >> np.uint64(64 - _BITS)).astype(np.int64)])
            text = np.searchsorted(first, at, "right") - 1
            inside = at + steps[-1] < first[text + 1]
            at, text = at[inside], text[inside]
            low, high = np.searchsorted(self.seeds, seed[at]), np.searchsorted(self.seeds, seed[at], "right")
            while (more := low < high).any():
                at, text, low, high = at[more], text[more], low[more], high[more]
                diagonals = np.unique(np.stack([text, self.items[low], at - first[text] - self.places[low]]), axis=1)
                found.update(map(tuple, diagonals.T.tolist()))
                low = low + 1
        return found

    def stretch(self, words: np.ndarray, item: int, shift: int) -> tuple[int, int, int]:
        """(equal words, start, end) of the best stretch of a text along one diagonal."""
        own = self.words[self.first[item] : self.first[item + 1]]
        start = max(0, shift)
        end = min(len(words), shift + len(own))
        score = np.where(words[start:end] == own[start - shift : end - shift], 1, -SUBSTITUTION)
        sums = np.concatenate([[0], np.cumsum(score)])
        low = np.minimum.accumulate(sums)
        last = int(np.argmax(sums - low))
        begin = int(np.flatnonzero(sums[: last + 1] == low[last])[-1])
        return int((score[begin:last] == 1).sum()), start + begin, start + last

    def needed(self, item: int, min_matched: int, share: float) -> float:
        return min(min_matched, share * (self.first[item + 1] - self.first[item]))


def indexes(benchmark: DataFrame, min_matched: int, share: float) -> Iterator[SeedIndex]:
    """Seed indexes of chunks of the benchmark."""
    items = only(benchmark, "item_id", "text").where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    chunks = max(1, -(-size["n"] // CHUNK), -(-size["bytes"] // CHUNK_BYTES))
    for k in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == k).collect() if chunks > 1 else items.collect()
        yield SeedIndex([r["item_id"] for r in rows], [r["text"] for r in rows], min_matched, share)


def _found(index: SeedIndex, column: pa.Array, min_matched: int, share: float) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item, equal words, start, end) for each contaminated row and item."""
    for row, data, offsets in textbatch.blocks(folded(column)):
        words, first = textbatch.word_hashes(data, offsets, gap=textbatch.PUNCTUATION)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, shift in index.hits(words, first):
            n, start, end = index.stretch(words[first[text] : first[text + 1]], item, shift)
            if n >= index.needed(item, min_matched, share):
                old = best.get((text, item))
                if old is None or (n, -start) > (old[0], -old[1]):
                    best[text, item] = n, start, end
        for (text, item), (n, start, end) in sorted(best.items()):
            yield row + text, index.ids[item], n, start, end


def overlaps(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED, share_of_item: float = SHARE_OF_ITEM) -> DataFrame:
    """doc_id, item_id, n_matched, start_word, end_word (exclusive) of each contaminated document and item."""
    source = only(docs, "doc_id", "text")
    of = lambda field: field.simpleString().replace(":", " ")
    schema = f"{of(source.schema['doc_id'])}, {of(benchmark.schema['item_id'])}, n_matched long, start_word long, end_word long"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for index in indexes(benchmark, min_matched, share_of_item):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [*_found(sent.value, batch.column(1), min_matched, share_of_item)]
                rows = [pa.array([x[k] for x in found], kind if k == 1 else pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows[0]), *rows[1:]], ["doc_id", "item_id", "n_matched", "start_word", "end_word"])

        part = mapped(source, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED, share_of_item: float = SHARE_OF_ITEM) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns."""
    at = docs.columns.index("text")
    for index in indexes(benchmark, min_matched, share_of_item):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {x[0] for x in _found(sent.value, batch.column(at), min_matched, share_of_item)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = mapped(docs, run, docs.schema)
    return docs


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
