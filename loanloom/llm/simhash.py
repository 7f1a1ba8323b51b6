"""Near-duplicate documents by SimHash, compared bit-sliced.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles, repeats
included. Documents whose fingerprints differ in RADIUS bits or fewer are linked, and components of links are
the groups.

Comparison: 64 fingerprints stand side by side in each word of 64 bit planes, one plane for each bit. A query
bit spread over a word and an XOR with the plane say for all 64 at once where they differ; carry-save adders count
that in two bit-sliced counters and a sticky overflow, which is distance 4 and more. Blocks whose fingerprints have
all overflowed are abandoned after every few planes.

How it scales: equal fingerprints are one class from the start. Classes meet in buckets: of RADIUS + 1 = 4 runs of
bits at least one is equal in a pair that is to be linked. A bucket of more than MEMBERS classes is divided again by
four runs of the bits that it leaves free, where that at least halves the comparisons, and is dealt out as pairs of tiles
otherwise, so no task holds more than about MEMBERS classes of a bucket at once and no link is lost. Tasks return the
edges of a spanning forest of what they compared, never all pairs.

Defined results: null, empty or blank text has fingerprint zero and is linked like any other. A null doc_id takes no
part (component null), its fingerprint is given. Rows that repeat a doc_id are
judged one by one, each by its own text; ties cannot occur, as the component is the smallest doc_id. Extra columns
are ignored. Very long texts are read whole, a chunk of shingles at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm import textbatch
from loanloom.llm.cluster import mapped, only, written
from loanloom.llm.near_dedup import components

SEED = 42
#: Counters have two bits, so the radius is what they hold.
RADIUS = 3
#: Most classes of a bucket that are compared in one task at once; beyond it the bucket is divided or tiled.
MEMBERS = 4096
#: Shingles whose bits are counted at once, and pairs of a query and a word of 64 classes compared at once.
CHUNK = 1 << 16
TASKS = 1 << 15
#: Planes between two looks at which blocks can be abandoned.
LOOK = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def _spans(data: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block joined by single spaces, starts and ends of its shingles there, and the shingles of each text."""
    data = textbatch.LOWER[data]
    starts, ends, first = textbatch.words(data, offsets)
    sizes = ends - starts
    solid = np.flatnonzero(~textbatch.SPACE[data])
    line = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    line[np.arange(len(solid)) + np.repeat(np.arange(len(sizes)), sizes)] = data[solid]
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    words = np.diff(first)
    shingles = np.where(words >= n_words, words - n_words + 1, (words > 0).astype(np.int64))
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(int(shingles.sum()))
    last = np.minimum(at + n_words, np.repeat(first[1:], shingles)) - 1
    return line.tobytes(), begins[at], begins[last] + sizes[last], shingles


def _majority(data: np.ndarray, offsets: np.ndarray, n_words: int) -> np.ndarray:
    line, begins, ends, shingles = _spans(data, offsets, n_words)
    counts = np.zeros((len(shingles), 64), np.int64)
    owner = np.repeat(np.arange(len(shingles)), shingles)
    for at in range(0, len(begins), CHUNK):
        a, b = begins[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + CHUNK]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_majority(data, offsets, words) for _, data, offsets in textbatch.blocks(batch.column(1))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return mapped(source, run, "doc_id long, fp long")


def divided(mask: int) -> list[int]:
    """mask with each of RADIUS + 1 runs of the bits that it leaves free: fingerprints equal under mask and within the
    radius are equal under one of them at least."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The labels (smallest index reached) of n members once a and b are joined pair by pair."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            again = label[label]
            if (again == label).all():
                break
            label = again


def compared(fps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indexes into fps) of spanning forests of the links within each group. first: where groups begin, and the
    length of fps."""
    sizes = np.diff(first)
    n = len(fps)
    slot = np.arange(n) - np.repeat(first[:-1], sizes)
    n_words = -(-sizes // 64)
    word0 = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    word = np.repeat(word0, sizes) + slot // 64  # of each member
    begins = np.flatnonzero(slot % 64 == 0)  # the first member of each word
    lane = (slot % 64).astype(np.uint64)
    planes = [np.bitwise_or.reduceat(((fps >> np.uint64(p)) & _ONE) << lane, begins) for p in range(64)]
    valid = np.bitwise_or.reduceat(_ONE << lane, begins)
    tasks = np.repeat(word0 + n_words, sizes) - word  # a query meets its own word and those after it
    done = np.concatenate([[0], np.cumsum(tasks)])
    label, at = np.arange(n), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(done, done[at] + TASKS, "right")) - 1)
        query = np.repeat(np.arange(at, end), tasks[at:end])
        block = word[query] + np.arange(len(query)) - (done[query] - done[at])
        own = block == word[query]
        over = ~np.where(own, valid[block] & ~((np.uint64(2) << lane[query]) - _ONE), valid[block])
        one = np.zeros(len(query), np.uint64)
        two = np.zeros(len(query), np.uint64)
        for p in range(0, 64, 2):
            if p % LOOK == 0:  # blocks of which all are too far are abandoned
                left = np.flatnonzero(over != _ALL)
                if len(left) < len(over):
                    query, block, over, one, two = query[left], block[left], over[left], one[left], two[left]
                if not len(left):
                    break
            bits = fps[query] >> np.uint64(p)
            x = planes[p][block] ^ (np.uint64(0) - (bits & _ONE))
            y = planes[p + 1][block] ^ (np.uint64(0) - ((bits >> _ONE) & _ONE))
            half = one ^ x
            carry = (one & x) | (half & y)
            one = half ^ y
            over |= two & carry
            two ^= carry
        hits = np.flatnonzero(over != _ALL)
        for k in range(0, len(hits), 4096):
            some = hits[k : k + 4096]
            task, bit = np.nonzero(np.unpackbits((~over[some]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = _roots(n, query[some][task], begins[block[some][task]] + bit, label)
        at = end
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the groups of rows (mask, value, i, j, fp) that come sorted by them; the last group waits for the next batch."""
    keys, rest = ("mask", "value", "i", "j"), None

    def linked(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.ones(table.num_rows, bool)
        if table.num_rows:
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = np.flatnonzero(new)
        stop = table.num_rows if last or not len(first) else int(first[-1])
        fps = table.column("fp").to_numpy()[:stop].view(np.uint64)
        first = np.append(first[first < stop], stop)
        a, b = compared(fps, first) if stop else (np.zeros(0, int), np.zeros(0, int))
        return pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (a, b)], ["a", "b"]), table.slice(stop)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        out, rest = linked(table, False)
        if out.num_rows:
            yield out
    if rest is not None and rest.num_rows:
        yield linked(rest, True)[0]


def _within(rows: DataFrame) -> DataFrame:
    """Edges (a, b) within the groups (mask, value, i, j) of rows."""
    keys = ["mask", "value", "i", "j"]
    dealt = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return mapped(dealt, _edges, "a long, b long")


def links(classes: DataFrame, members: int | None = None) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fp of classes whose components are those of all links."""
    members = members or MEMBERS
    spark = classes.sparkSession
    key, found, masks = ["mask", "value"], None, [0]
    open_ = classes.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"))
    while masks:
        # the masks of a level follow from a rule: at most 4 for each of the level before, 4^6 in all
        below = {m: divided(m) for m in masks}
        table = spark.createDataFrame([(_signed(m), [_signed(x) for x in below[m]]) for m in masks], "mask long, below array<long>")
        each = open_.join(F.broadcast(table), "mask").select("fp", F.col("mask").alias("up"), F.col("value").alias("up_value"), F.explode("below").alias("mask"))
        each = each.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = each.groupBy("up", "up_value", *key).agg(F.count("*").alias("n")).where("n > 1")
        if found is not None:  # a bucket is divided where that at least halves its comparisons
            cost = sizes.groupBy("up", "up_value").agg(F.sum(F.col("n").cast("double") ** 2).alias("cost"))
            cost = cost.select(F.col("up").alias("mask"), F.col("up_value").alias("value"), "cost")
            known = written(large.join(cost, key, "left").select(*key, "n", (F.coalesce("cost", F.lit(0.0)) * 2 > F.col("n").cast("double") ** 2).alias("tiled")), "buckets")
            n_tiles = F.ceil(F.col("n") * 2 / F.lit(members)).cast("int")
            tiled = open_.join(known.where("tiled").select(*key, n_tiles.alias("k")), key)
            tile = F.pmod(F.xxhash64("fp"), "k").cast("int")
            tiled = tiled.select("fp", *key, tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
            found = found.unionByName(written(_within(tiled.select("fp", *key, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))), "links"))
            kept = known.where("not tiled").select(F.col("mask").alias("up"), F.col("value").alias("up_value"))
            each, sizes = each.join(kept, ["up", "up_value"], "left_semi"), sizes.join(kept, ["up", "up_value"], "left_semi")
        # a bucket may come from several of the level before, with different members
        path = ["up", "up_value", *key]
        sizes = written(sizes, "sizes")
        each = written(each.join(sizes, path), "members")
        small = each.where(F.col("n") <= members).select("fp", *key, F.xxhash64("up", "up_value").alias("i"), F.lit(0).cast("long").alias("j"))
        now = written(_within(small), "links")
        found = now if found is None else found.unionByName(now)
        open_ = each.where(F.col("n") > members).select("fp", *key).distinct()
        open_ = written(open_, "open")
        large = open_.groupBy(*key).agg(F.count("*").alias("n"))
        masks = [x["mask"] % (1 << 64) for x in large.select("mask").distinct().collect()]
    return found.distinct()


def grouped(prints: DataFrame, members: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of the rows (doc_id, fp) of fingerprints()."""
    prints = written(prints, "prints")
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = written(links(classes, members), "edges")
    labels = components(edges).select(F.col("id").alias("fp"), F.col("component").alias("label"))
    named = written(classes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "label").select("fp", "component_id"), "components")
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs; see the top of this file."""
    return grouped(fingerprints(docs, words))
