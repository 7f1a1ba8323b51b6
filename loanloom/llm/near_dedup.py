"""Near-duplicate documents by min-max hashing.

Each document is the set of its distinct word shingles. Under each of K permutations both the smallest
and the largest hash are kept, so 2K signature values cost K hash evaluations; either value is equal in
two sets with a probability of exactly their Jaccard similarity, and bands of ROWS values find pairs.
The number of bands follows from the threshold: a pair at the threshold is missed with a probability of
at most MISS. Links are confirmed on the full sets, and components of links are the groups.

How it scales: equal sets are one class from the start, so copies never meet each other. A bucket is
never expanded into all pairs: each round compares all its members with a few pivots, joins what is
linked into components and retires the pivots, until the members left in each bucket are in one component.
Every pair of a bucket that isn't linked by way of others has then been compared, so no link is lost.
Pivots are the members with the fewest shingles of their own. Pairs whose sizes and shared shingles bound
their similarity below the threshold are left out, which costs no link: a document that is far from all
others has many shingles that no other candidate has. What is still compared after the first round is tested
once more by its rare shingles, after which only frequent ones count for the bound.
The skewed joins have plain shuffles on both sides, which adaptive execution splits.

Defined results: null or blank text is an empty set, linked with nothing. A null doc_id takes no part
(component null, kept). Rows that repeat a doc_id are judged by their class: rows equal in both are one, others
are documents of their own. Ties cannot occur: the
component is the smallest doc_id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm import textbatch
from loanloom.llm.cluster import discarded, mapped, only, written

ROWS = 4
MISS = 1e-7
#: A shingle of at most so many of the sets still compared is rare; its pairs are tested one by one.
RARE = 8
#: Each round takes so many times the pivots of the one before; every round carries all open buckets along.
STEP = 16
#: In the round with so many pivots (buckets of fewer members are done) pairs of rare shingles are tested.
RARE_ROUND = 16
#: Sets of ids up to this size are broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _sets(column: pa.Array, n_words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in textbatch.blocks(column):
        hashes, first = textbatch.word_hashes(data, offsets)
        shingles = textbatch.joined(hashes, tuple(range(n_words)))
        for k in range(len(offsets) - 1):
            a, b = first[k], first[k + 1]
            if b - a >= n_words:
                yield np.unique(shingles[a : b - n_words + 1])
            elif b > a:  # the whole sequence is the one shingle; its length keeps it apart
                yield textbatch.joined(np.append(hashes[a:b], np.uint64(b - a)), tuple(range(b - a + 1)))
            else:
                yield np.zeros(0, np.uint64)


def _digest(shingles: np.ndarray) -> tuple[int | None, int | None]:
    if not len(shingles):
        return None, None
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class _Signer:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(20240630)
        k = -(-bands * rows // 2)
        self.factor = random.integers(0, 1 << 63, k, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.flip = random.integers(0, 1 << 63, k, dtype=np.uint64)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(shingles), 4096):
            x = (shingles[None, at : at + 4096] ^ self.flip) * self.factor
            a, b = x.min(axis=1), x.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        values = np.concatenate([low, high])[: self.bands * self.rows].reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64) + np.uint64(77)
        for j in range(self.rows):
            key = textbatch.mixed(key * np.uint64(0xD6E8FEB86659FD93) + values[:, j])
        return key.view(np.int64)


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (hi, lo; null for an empty one) and its band keys."""
    bands, rows = band_count(percent), ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _Signer(bands, rows)
        for batch in batches:
            n, hi, lo, keys = [], [], [], []
            for s in _sets(batch.column(1), words):
                n.append(len(s))
                a, b = _digest(s)
                hi.append(a)
                lo.append(b)
                if len(s):
                    keys.append(sign(s))
            sizes = np.array([0, *(bands if x else 0 for x in n)]).cumsum()
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "hi", "lo", "bands"],
            )

    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return mapped(source, run, "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def digested(docs: DataFrame, words: int) -> DataFrame:
    """doc (the whole row), doc_id, text and the class digest (hi, lo) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(s) for s in _sets(batch.column(2), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], ["doc", "doc_id", "text", "hi", "lo"])

    source = docs.select(F.struct(*docs.columns).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return mapped(source, run, T.StructType([*source.schema, T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and set (sorted hashes) of the documents in ids."""
    near = F.broadcast(ids) if ids.count() * 8 <= BROADCAST_BYTES else ids
    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    source = source.join(near.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch.column(1), words)]
            sizes = np.array([0, *(len(s) for s in sets)]).cumsum()
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["id", "shingles"])

    return mapped(source, run, "id long, shingles array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; only sets that a pair needs are sent."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if ids.count() * 8 <= BROADCAST_BYTES:
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    found = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    found = found.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return found.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """id, n (size of the set) and c (its shingles that another candidate has too)."""
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    return sets.select("id", F.size("shingles").cast("long").alias("n")).join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


def rare_partners(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sets that are still compared: all pairs (a, b) that share a shingle of at most RARE of them, and
    id with c, the shingles of more than RARE. Once the pairs are tested, no other pair shares more than c."""
    each = written(sets.select("id", F.explode("shingles").alias("shingle")).distinct(), "shingles")
    rare = written(each.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE), "rare")
    held = each.join(rare, "shingle")
    groups = held.where("n > 1").groupBy("shingle").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.lit(RARE)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = groups.select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.*").distinct()
    left = sets.select("id", F.size("shingles").cast("long").alias("n")).join(held.groupBy("id").agg(F.count("*").alias("rare")), "id", "left")
    return pairs, left.select("id", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("c"))


def possible(c: Column, sizes: Column, percent: int) -> Column:
    """Whether two sets of so many shingles together could be linked when at most c are in both: their
    similarity is then at most c / (sizes - c)."""
    return c * (100 + percent) >= sizes * percent


def stars(edges: DataFrame) -> bool:
    """Whether every b of the distinct edges (a, b) has one a, which is no b itself."""
    ends = edges.select(F.col("b").alias("id"), F.lit(1).alias("below")).unionByName(edges.select(F.col("a").alias("id"), F.lit(0).alias("below")))
    return ends.groupBy("id").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id that can be reached) of all ids in edges (a, b): alternating large-star
    and small-star rounds, each pointing a node's neighbours at its smallest one, until all are stars."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = written(large.distinct(), "large")
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "small")
        # each smaller neighbour, and the node itself, is pointed at the smallest
        moved = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = written(moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of labels (stars already) once links are added."""
    if labels is None:
        return components(links)
    return components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs; see the top of this file."""
    return judged(docs, words, percent)[0].drop("hi", "lo")


def judged(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of near_duplicates with their class (hi, lo), and the doc_ids that repeat."""
    signed = written(signatures(docs, words, percent), "signatures")
    repeated = written(signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return grouped(docs, signed, words, percent), repeated
    # each (doc_id, class) gets an id of its own, in the order of doc_id, so the smallest id has the smallest doc_id
    rows = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "hi", "lo").distinct().orderBy("doc_id", "hi", "lo")
    rows = written(rows.select("*", F.monotonically_increasing_id().alias("id")), "rows")
    keys = ["doc_id", "hi", "lo"]
    own = signed.join(rows, keys).drop("doc_id").withColumnRenamed("id", "doc_id").dropDuplicates(["doc_id"])
    texts = digested(docs, words).join(rows, keys).groupBy("id").agg(F.min("text").alias("text")).select(F.col("id").alias("doc_id"), "text")
    own = written(own.select(*signed.columns), "signatures")
    found = grouped(written(texts, "texts"), own, words, percent).select(F.col("doc_id").alias("id"), F.col("component_id").alias("component"), "kept")
    first = rows.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
    found = found.join(rows, "id").join(first, "component").select(*keys, "component_id", "kept")
    out = signed.select("doc_id", "n_shingles", "hi", "lo").join(found, keys, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept"), "hi", "lo"), repeated


def grouped(docs: DataFrame, signed: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of judged() where no doc_id repeats; signed: the signatures of docs."""
    used = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(used.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    reps = used.join(classes, ["hi", "lo"]).where("doc_id = rep").select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    reps = written(reps, "bands")
    shared = written(reps.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "buckets")
    members = written(reps.join(shared, "band").select("band", "id"), "members")
    sets = written(shingle_sets(docs, members.select("id").distinct(), words), "sets")
    figures = written(shared_shingles(sets), "figures")
    # component starts as the id; members of open buckets are compared round by round
    active = written(members.join(figures, "id").select("band", "id", F.col("id").alias("component"), "n", "c"), "active")
    for table in (reps, shared, figures):
        discarded(table)
    tested = labels = None
    pivots_per_bucket = 1
    while True:
        buckets = active.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("smallest")).where("x < y").select("band", "smallest")
        buckets = written(buckets, "open")
        if buckets.isEmpty():
            break
        before, active = active, active.join(buckets, "band")
        passed = [buckets]
        if pivots_per_bucket == STEP:
            # from here on members know all their buckets, so that a pair is made in the first one alone
            homes = members.join(active.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_list("band").alias("bands"))
            active = active.join(homes, "id")
        if pivots_per_bucket == RARE_ROUND:
            active = written(active, "active")
            passed.append(active)
            pairs, common = rare_partners(sets.join(active.select("id").distinct(), "id", "left_semi"))
            pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.unionByName(pairs)
            more = written(linked(pairs, sets, percent), "links")
            if not more.isEmpty():
                labels = joined_components(labels, more)
            active = active.drop("c", "component").join(written(common, "figures"), "id").join(labels, "id", "left")
            active = active.withColumn("component", F.coalesce("component", "id"))
        # with too few shared shingles for even the smallest of its bucket, a member has no link there
        active = active.where(possible(F.col("c"), F.col("n") + F.col("smallest"), percent)).drop("smallest")
        central = F.struct((F.col("n") - F.col("c")).alias("alone"), "id")
        if pivots_per_bucket == 1:
            pivots = active.groupBy("band").agg(F.min_by(F.struct("id", "component", "n", "c"), central).alias("p")).select("band", "p.*")
        else:
            rank = F.row_number().over(W.partitionBy("band").orderBy(F.col("n") - F.col("c"), "id"))
            pivots = active.withColumn("rank", rank).where(F.col("rank") <= pivots_per_bucket).select("band", "id", "component", "n", "c")
        pivots = written(pivots, "pivots")
        other = pivots.join(pivots.groupBy("id").agg(F.collect_list("band").alias("pivot_of")), "id")
        other = other.select("band", F.col("id").alias("pivot"), F.col("component").alias("of"), F.col("n").alias("pivot_n"), F.col("c").alias("pivot_c"), "pivot_of")
        both = F.col("n") + F.col("pivot_n")
        near = possible(F.least("c", "pivot_c"), both, percent) & (F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent)
        # a member that has left the first bucket it shares with a pivot was compared or ruled out there
        first = F.array_min(F.array_intersect("bands", "pivot_of")) == F.col("m.band") if "bands" in active.columns else F.lit(True)
        pairs = active.alias("m").join(other.alias("p"), (F.col("m.band") == F.col("p.band")) & (F.col("component") != F.col("of")) & near & first)
        pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = written(linked(pairs, sets, percent), "links")
        if labels is None or not more.isEmpty():  # without new links the components stay as they are
            labels = joined_components(labels, more)
        rest = active.join(pivots.select("band", "id"), ["band", "id"], "left_anti").drop("component")
        rest = written(rest.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "active")
        for table in (*passed, before, pivots, more):
            discarded(table)
        active = rest
        pivots_per_bucket *= STEP
    result = signed.select("doc_id", "n_shingles", "hi", "lo").join(classes, ["hi", "lo"], "left")
    if labels is not None:
        result = result.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        result = result.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    result = result.select("doc_id", "n_shingles", component.alias("component_id"), "hi", "lo")
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "hi", "lo")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the smallest doc_id, and of rows equal in class and doc_id the one of
    the smallest text."""
    found, repeated = judged(docs, words, percent)
    dropped = written(found.where("not kept").select("doc_id", "hi", "lo").distinct(), "near")
    n = dropped.count()
    near = F.broadcast(dropped.select("doc_id").distinct()) if n * 8 <= BROADCAST_BYTES else dropped.select("doc_id").distinct()
    n = repeated.count()
    if not n:
        return docs.join(near, "doc_id", "left_anti").select(*docs.columns)
    again = F.broadcast(repeated) if n * 8 <= BROADCAST_BYTES else repeated
    single = docs.join(again, "doc_id", "left_anti").join(near, "doc_id", "left_anti").select(*docs.columns)
    each = digested(docs.join(again, "doc_id", "left_semi").select(*docs.columns), words).join(dropped, ["doc_id", "hi", "lo"], "left_anti")
    one = each.groupBy("doc_id", "hi", "lo").agg(F.min_by("doc", F.struct("text", F.to_json("doc"))).alias("doc"))
    return single.unionByName(one.select("doc.*"))
