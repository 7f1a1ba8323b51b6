"""Hard negatives of labelled vectors: for each anchor and each of its best rows of the same label, the best rows of
other labels whose score lies in a window below the positive's.

Rows are put in the order of a Hilbert curve through their components and stored as blocks of at most BLOCK rows, one
Parquet row for each block, with a zone map: the least and the greatest value of each dimension and the labels that occur. For
an anchor, interval arithmetic over a zone map bounds all scores in the block from both sides. What an anchor looks for
is a window of scores and a number of rows; its own block tells how good these are at least, and only blocks whose bounds
reach that part of the window, and that hold a fitting label, are read. Anchors and blocks meet in a join on the block;
scores of the anchors that need it are one matrix product.

How it scales: a block meets only anchors whose bounds call for it, in groups of GROUP windows, and each task passes on
the best rows of each window alone. No group, block or zone chunk grows with the data; nothing is broadcast. Where vectors
are spread evenly in many dimensions, as random ones are, bounds are wide and most blocks are read: the work then is
that of all anchors against all rows, in blocks.

Defined results: rows with a null vec_id, label or vector or a component that is null or not finite take no part; nor do rows
with a component so large that a score could pass 2^59. Vectors of different lengths are compared over the components
they share. Repeated rows are rows of their own, so an equal row of the same vec_id may be a positive. Ties go to the smaller vec_id.
Equal vectors, however many, are dealt out by vec_id too. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm.cluster import mapped, written

BLOCK = 4096
GROUP = 256
#: Zone maps that are bounded at once.
ZONES = 1024
#: Bits of each dimension in the Hilbert key.
BITS = 4
#: Found rows that a task holds before it keeps the best alone.
HELD = 1 << 18
POSITIVES, NEGATIVES = 5, 10
ANCHOR_EVERY = 100
_LOW, _HIGH = -(1 << 62), 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of cells (n x dimensions, values below 2^bits) on a Hilbert curve, as bytes that sort
    like it: the transposed form of Skilling's method, its bits then taken level by level."""
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations of the finer levels
        below = np.uint32(level - 1)
        for i in range(n):
            set_ = (x[i] & np.uint32(level)) != 0
            swap = np.where(set_, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & np.uint32(level)) != 0, np.uint32(level - 1), np.uint32(0))
        level >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b (integers), in floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(found: np.ndarray, k: int) -> np.ndarray:
    """The first k columns of each (window, rank) in found: rows window, rank, score, id; scores descending, then ids."""
    order = np.lexsort((found[3], -found[2], found[1], found[0]))
    found = found[:, order]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    place = np.arange(found.shape[1])
    return found[:, place - np.maximum.accumulate(np.where(new, place, 0)) < k]


def _ints(value: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(value, kind)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec of the rows that take part, labels changed where vec_id is divisible by 7."""
    vec = vectors["embedding"].cast("array<double>")
    vec_id, label = vectors["vec_id"].cast("long"), vectors["label"].cast("long")
    rows = vectors.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), vec.alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~odd)


def blocks(rows: DataFrame, dims: int, low: float, high: float, size: int = BLOCK) -> DataFrame:
    """block, n, ids, labels, vecs (binary), lo, hi and kinds (labels that occur) of rows in Hilbert order."""
    limit = math.isqrt((1 << 59) // dims)
    low, high = math.floor(max(low, -limit)), math.floor(min(high, limit))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            vec = np.zeros((batch.num_rows, dims))
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            vec[np.repeat(np.arange(len(sizes)), sizes), at] = batch.column(2).flatten().to_numpy()
            with np.errstate(over="ignore"):
                vec = np.floor(256 * vec)
            fits = (np.abs(vec) <= limit).all(axis=1)
            vec = vec[fits]
            cells = np.minimum((vec - low) * ((1 << BITS) / (high - low + 1)), (1 << BITS) - 1).astype(np.uint32)
            keys = hilbert_keys(cells, BITS) if len(vec) else []
            own = batch.filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([v.tobytes() for v in vec.astype(np.int32)], pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "vec", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rest = TaskContext.get().partitionId() << 31, None
        names = ["block", "n", "ids", "labels", "vecs", "lo", "hi", "kinds"]

        def block(table: pa.Table) -> pa.RecordBatch:
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            vecs = _ints(b"".join(table.column("vec").to_pylist()), np.int32).reshape(len(ids), dims)
            values = [first, len(ids), ids.tobytes(), labels.tobytes(), vecs.tobytes(), vecs.min(axis=0).tobytes(), vecs.max(axis=0).tobytes(), np.unique(labels).tobytes()]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= size:
                yield block(rest.slice(0, size))
                rest, first = rest.slice(size), first + 1
        if rest is not None and rest.num_rows:
            yield block(rest)

    keys = mapped(rows.select("vec_id", "label", "vec"), keyed, "vec_id long, label long, vec binary, key binary")
    ordered = keys.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    return written(mapped(ordered, packed, "block long, n long, ids binary, labels binary, vecs binary, lo binary, hi binary, kinds binary"), "blocks")


def anchors(stored: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """a (the place of the row: block * size + slot), anchor_id, label and vec of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, labels, vecs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = _ints(ids)
                at = np.flatnonzero(ids % ANCHOR_EVERY == 0)
                vecs = _ints(vecs, np.int32).reshape(len(ids), dims)
                yield pa.RecordBatch.from_arrays([pa.array(number * size + at), pa.array(ids[at]), pa.array(_ints(labels)[at]), pa.array([vecs[k].tobytes() for k in at], pa.binary())], ["a", "anchor_id", "label", "vec"])

    return mapped(stored.select("block", "ids", "labels", "vecs"), run, "a long, anchor_id long, label long, vec binary")


_WINDOWS = "a binary, r binary, label binary, low binary, high binary, vec binary"


def grouped(windows: DataFrame, home: str) -> DataFrame:
    """Windows (a, r, label, low, high, vec) in rows of at most GROUP that agree in the expression home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def row() -> pa.RecordBatch:
            columns = [np.array([x[k] for x in held], np.int64).tobytes() for k in range(1, 6)]
            return pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([c], pa.binary()) for c in (*columns, b"".join(x[6] for x in held)))], ["home", "a", "r", "label", "low", "high", "vec"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (x[0] != at or len(held) == GROUP):
                    yield row()
                    held = []
                at = x[0]
                held.append(x)
        if held:
            yield row()

    rows = windows.select(F.expr(home).alias("home"), "a", "r", "label", "low", "high", "vec")
    return mapped(rows.repartition("home").sortWithinPartitions("home", "a", "r"), run, "home long, " + _WINDOWS)


def needed(groups: DataFrame, stored: DataFrame, dims: int, same: bool) -> DataFrame:
    """The blocks that the windows of groups must read by the blocks' zone maps: block and the windows."""
    chunks = max(1, -(-stored.count() // ZONES))
    zone = stored.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("c"), F.struct("block", "lo", "hi", "kinds").alias("z"))
    zones = zone.groupBy("c").agg(F.collect_list("z").alias("zones"))  # about ZONES of them each
    dealt = groups.drop("home").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(zones, "c").drop("c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *parts, vec, zones in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, r, label, low, high = map(_ints, parts)
                vec = _ints(vec, np.int32).reshape(len(a), dims).astype(np.int64)
                lo, hi = (np.stack([_ints(z[k], np.int32) for z in zones]).astype(np.int64) for k in ("lo", "hi"))
                up, down = np.maximum(vec, 0), np.minimum(vec, 0)
                most, least = dot(up, hi) + dot(down, lo), dot(up, lo) + dot(down, hi)
                use = (most >= low[:, None]) & (least <= high[:, None])
                for k, z in enumerate(zones):
                    kinds = _ints(z["kinds"])
                    fits = np.isin(label, kinds) if same else (len(kinds) > 1) | (label != kinds[0])
                    at = np.flatnonzero(use[:, k] & fits)
                    if len(at):
                        columns = [x[at].tobytes() for x in (a, r, label, low, high)] + [vec[at].astype(np.int32).tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([z["block"]]), *(pa.array([c], pa.binary()) for c in columns)], ["block", "a", "r", "label", "low", "high", "vec"])

    return mapped(dealt.select("a", "r", "label", "low", "high", "vec", "zones"), run, "block long, " + _WINDOWS)


def read(need: DataFrame, stored: DataFrame, dims: int, same: bool, k: int, size: int = BLOCK) -> DataFrame:
    """a, r, score, id: of what the windows want, the best k rows of each in the blocks of need, task by task."""
    joined = need.join(stored.select("block", "ids", "labels", "vecs"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["a", "r", "score", "id"])
        for batch in batches:
            for block, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, r, label, low, high = map(_ints, parts[:5])
                ids, labels = map(_ints, parts[6:8])
                mine, theirs = (_ints(x, np.int32).reshape(-1, dims) for x in (parts[5], parts[8]))
                _, at, back = np.unique(a, return_index=True, return_inverse=True)
                scores = dot(mine[at], theirs)[back]
                fits = (scores >= low[:, None]) & (scores <= high[:, None]) & ((labels == label[:, None]) == same)
                own = np.flatnonzero(a // size == block)
                fits[own, a[own] % size] = False
                if fits.shape[1] > k:  # the k-th best of each, ties with it stay
                    worst = np.partition(np.where(fits, scores, _LOW), -k, axis=1)[:, -k]
                    fits &= scores >= worst[:, None]
                x, y = np.nonzero(fits)
                held.append(np.stack([a[x], r[x], scores[x, y], ids[y]]))
                n += len(x)
                if n > HELD:
                    held = [best(np.concatenate(held, axis=1), k)]
                    n = held[0].shape[1]
                    if n > HELD // 2:
                        yield out(held.pop())
                        n = 0
        if held:
            yield out(best(np.concatenate(held, axis=1), k))

    columns = ["block", "a", "r", "label", "low", "high", "vec", "ids", "labels", "vecs"]
    return mapped(joined.select(*columns), run, "a long, r long, score long, id long")


def first_rows(windows: DataFrame, stored: DataFrame, dims: int, same: bool, k: int, size: int = BLOCK) -> DataFrame:
    """a, r, place (from 1), score, id: the best k rows of each window."""
    own = grouped(windows, f"a div {size}").withColumnRenamed("home", "block")
    seeds = read(own, stored, dims, same, k, size).groupBy("a", "r").agg(F.count("*").alias("n"), F.min("score").alias("seed")).where(F.col("n") == k)
    raised = windows.join(seeds, ["a", "r"], "left").withColumn("low", F.greatest("low", "seed"))
    groups = grouped(raised, f"(a div {size}) >> 31")
    need = written(needed(groups, stored, dims, same), "needed")
    place = F.row_number().over(W.partitionBy("a", "r").orderBy(F.desc("score"), "id"))
    return read(need, stored, dims, same, k, size).select("a", "r", place.alias("place"), "score", "id").where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the top of this file."""
    rows = usable(vectors)
    seen = rows.agg(F.max(F.size("vec")).alias("dims"), (F.min(F.array_min("vec")) * 256).alias("low"), (F.max(F.array_max("vec")) * 256).alias("high")).first()
    dims = max(seen["dims"] or 1, 1)
    stored = blocks(rows, dims, seen["low"] or 0.0, seen["high"] or 0.0, size)
    own = written(anchors(stored, dims, size), "anchors")
    windows = own.select("a", F.lit(0).cast("long").alias("r"), "label", F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"), "vec")
    positives = first_rows(windows, stored, dims, True, POSITIVES, size)
    positives = written(positives.select("a", F.col("place").cast("long").alias("r"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 30 * positive <= 100 * negative <= 90 * positive, in whole numbers
    up = F.expr("(9 * positive_score - pmod(9 * positive_score, 10)) div 10")
    down = F.expr("-((-3 * positive_score - pmod(-3 * positive_score, 10)) div 10)")
    windows = positives.join(own, "a").select("a", "r", "label", down.alias("low"), up.alias("high"), "vec").where("low <= high")
    found = first_rows(written(windows, "windows"), stored, dims, False, NEGATIVES, size)
    found = found.join(positives, ["a", "r"]).join(own.select("a", "anchor_id"), "a")
    return found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p, ps, b, s, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b) AS rank FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE rank <= {NEGATIVES}
"""
