"""Frequent phrases and how much more often they occur than their parts, mined as relations (SETM).

The relation R1 holds the occurrences (document, position, word) of frequent words, sorted; words of different pieces of
a text never stand at adjacent positions. R(k+1) comes from R(k) by a merge join of the sorted relation with itself
at adjacent positions: the first and the last k words of a phrase of k + 1 words are both frequent phrases. Groups are
counted, frequent ones kept, and the relation semi-joined with them before it is extended again.

How it scales: a relation is stored with one row for each document, its positions and phrases as sorted arrays, so
the merge join needs no shuffle and only counts are moved, summed up in the tasks first. The table of frequent groups of
a level is broadcast up to BROADCAST_BYTES; beyond it the occurrences are joined with it by a shuffle and put
together again by document. Relations that are no longer needed are deleted. Phrases, their cuts and what they are part of
are joined as tables of frequent phrases, which are few beside their occurrences. Words are told apart by their
text, not by a hash.

Defined results: null text is empty, null lang is `und`. Repeated rows and rows without doc_id count each on their own;
doc_id isn't used. The lowest-scoring cut counts, among equals the one after the fewest words; phrases rank by
score, then count, then UTF-8 order. Very long texts are read in chunks. Extra columns are ignored. Empty tables give an
empty result. Scores are exact while 1000 * a * n stays below 10^38.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm import textbatch
from loanloom.llm.cluster import discarded, mapped, written

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Frequent groups of a level up to this size are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of a text that are split at once, and counts that a task sums up before it passes them on.
CHUNK = 1 << 20
COUNTS = 1 << 20
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists, with an empty one between pieces."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        cut = at + CHUNK
        if cut < len(text):
            ends = [x for x in (text.find(b" ", cut), text.find(b"\n", cut)) if x >= 0]
            cut = min(ends, default=len(text))
        words: list[bytes] = []
        for k, piece in enumerate(text[at:cut].split(b"\n")):
            if k:
                words.append(b"")
            words += piece.split()
        yield words
        at = cut  # a break there begins the next chunk


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in textbatch.pieces(batches):
        yield batch, batch.column(1).cast(pa.binary()).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "f"])

        for batch, texts in _texts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for words in _chunks(text):
                    counts[lang].update(words)
            if sum(map(len, counts.values())) > COUNTS:
                yield out()
        yield out()

    return mapped(_source(docs), run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def _rows(doc: pa.Array, sizes: list[int], pos: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(ends, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(item.astype(np.int64)))], ["doc", "pos", "item"])


_RELATION = "doc long, pos array<int>, item array<long>"


def occurrences(docs: DataFrame, words: DataFrame, limit: int | None = None) -> DataFrame:
    """R1: the places of the frequent words (lang, word, item) in each row of docs."""
    limit = BROADCAST_BYTES if limit is None else limit
    source = _source(docs).withColumn("doc", F.monotonically_increasing_id())
    spark = docs.sparkSession
    bytes_ = words.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 120)).first()[0] or 0
    near = bytes_ <= limit
    known: dict[str, _Ids] = defaultdict(_Ids)
    if near:
        for r in words.collect():
            known[r["lang"]][r["word"].encode()] = r["item"]
    shared = spark.sparkContext.broadcast(dict(known))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            pos, item, sizes = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids, begin, n = shared.value.get(lang) or _Ids(), 0, 0
                for words in _chunks(text):
                    found = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                    at = np.flatnonzero(found >= 0)
                    pos.append(at + begin)
                    item.append(found[at])
                    begin, n = begin + len(words), n + len(at)
                sizes.append(n)
            none = [np.zeros(0, np.int64)]
            yield _rows(batch.column(2), sizes, np.concatenate(pos or none), np.concatenate(item or none))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            for lang, doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                begin = 0
                for words in _chunks(text):
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.arange(begin, begin + n, dtype=np.int32)), pa.array([lang] * n, pa.string()), pa.array(words, pa.binary()).cast(pa.string())], ["doc", "pos", "lang", "word"])
                    begin += n

    if near:
        return mapped(source, places, _RELATION)
    each = written(mapped(source, spelled, "doc long, pos int, lang string, word string"), "words")
    return _put_together(each.join(words.select("lang", "word", "item"), ["lang", "word"]))


def _put_together(each: DataFrame) -> DataFrame:
    rows = each.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("x"))
    return rows.select("doc", F.col("x.pos").alias("pos"), F.col("x.item").alias("item"))


def _adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of the relation's rows with themselves at the next position: positions, left and right items,
    and the row of each pair."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    pos, item = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((pos[1:] == pos[:-1] + 1) & (row[1:] == row[:-1]))
    return pos[at], item[at], item[at + 1], row[at]


def pair_counts(relation: DataFrame) -> DataFrame:
    """left, right, f of the adjacent pairs in the relation."""

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        """(left, right, f) with one row for each pair."""
        left, right, f = np.concatenate(parts, axis=1)
        a, x = np.unique(left, return_inverse=True)
        b, y = np.unique(right, return_inverse=True)
        key, back = np.unique(x * np.int64(len(b)) + y, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, f)
        return np.stack([a[key // max(len(b), 1)], b[key % max(len(b), 1)], total]) if len(key) else np.zeros((3, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["left", "right", "f"])
        for batch in batches:
            _, left, right, _ = _adjacent(batch)
            if len(left):
                held.append(np.stack([left, right, np.ones(len(left), np.int64)]))
            if sum(x.shape[1] for x in held) > COUNTS:
                held = [summed(held)]
                if held[0].shape[1] > COUNTS // 2:
                    yield out(held.pop())
        if held:
            yield out(summed(held))

    return mapped(relation, run, "left long, right long, f long").groupBy("left", "right").agg(F.sum("f").alias("f"))


def extended(relation: DataFrame, groups: DataFrame, limit: int | None = None) -> DataFrame:
    """The next relation: adjacent pairs of the relation that are in groups (left, right, item)."""
    limit = BROADCAST_BYTES if limit is None else limit
    if groups.count() * 24 > limit:

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pos, left, right, row = _adjacent(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos), pa.array(left), pa.array(right)], ["doc", "pos", "left", "right"])

        each = mapped(relation, pairs, "doc long, pos int, left long, right long")
        return _put_together(each.join(groups.select("left", "right", "item"), ["left", "right"]))
    rows = np.array([(r["left"], r["right"], r["item"]) for r in groups.collect()], np.int64).reshape(-1, 3)
    firsts, lasts = np.unique(rows[:, 0]), np.unique(rows[:, 1])
    key = np.searchsorted(firsts, rows[:, 0]) * np.int64(len(lasts)) + np.searchsorted(lasts, rows[:, 1])
    order = np.argsort(key)
    shared = relation.sparkSession.sparkContext.broadcast((firsts, lasts, key[order], rows[order, 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, keys, items = shared.value
        for batch in batches:
            pos, left, right, row = _adjacent(batch)
            if not len(keys):
                continue
            x = np.minimum(np.searchsorted(firsts, left), len(firsts) - 1)
            y = np.minimum(np.searchsorted(lasts, right), len(lasts) - 1)
            k = x * np.int64(len(lasts)) + y
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            in_ = np.flatnonzero((firsts[x] == left) & (lasts[y] == right) & (keys[at] == k))
            yield _rows(batch.column(0), np.bincount(row[in_], minlength=batch.num_rows).tolist(), pos[in_], items[at[in_]])

    return mapped(relation, run, _RELATION)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of 1 to longest words that occur min_count times or more, and (lang, n)."""
    counts = written(word_counts(docs), "counts")
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    level = counts.where(F.col("f") >= min_count).select("lang", "word", "f", F.monotonically_increasing_id().alias("item"))
    level = written(level, "frequent")
    relation = written(occurrences(docs, level, limit), "relation")
    level = level.select("item", "lang", F.array("word").alias("words"), "f")
    found = level
    for k in range(2, longest + 1):
        groups = pair_counts(relation).where(F.col("f") >= min_count).select("left", "right", "f", F.monotonically_increasing_id().alias("item"))
        groups = written(groups, "groups")
        left = level.select(F.col("item").alias("left"), "lang", F.col("words").alias("before"))
        right = level.select(F.col("item").alias("right"), F.element_at("words", -1).alias("after"))
        level = written(groups.join(left, "left").join(right, "right").select("item", "lang", F.concat("before", F.array("after")).alias("words"), "f"), "phrases")
        found = found.unionByName(level)
        if k < longest:
            more = written(extended(relation, groups, limit), "relation")
            discarded(relation)
            relation = more
    discarded(relation)
    return found.select("lang", "words", "f"), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, limit: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; see the top of this file."""
    phrases, totals = frequent_phrases(docs, min_count, longest, limit)
    phrases = written(phrases, "phrases")
    several = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.expr("slice(words, 1, k)").alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "words", "x.*")
    longer = several.where(F.size("words") > 2)
    inner = longer.select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("len"))
    inner = inner.select("lang", "words", "a", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("from"))
    inner = inner.groupBy("lang", F.expr("slice(words, from, len)").alias("words")).agg(F.max("a").alias("around"))
    kept = scored.join(inner, ["lang", "words"], "left").where("around is null or 100 * around < 100 * a")
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "n", "score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score").where(F.col("rank") <= top)


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i:i + k - 1] AS w FROM i, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, w, count(*) AS f FROM g GROUP BY lang, w HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, w, f AS a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (SELECT c.lang, c.w, c.a, c.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.w = c.w[1:c.k] JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1:len(c.w)] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
x AS (SELECT lang, w, f, unnest(range(2, len(w))) AS m FROM f WHERE len(w) > 2),
y AS (SELECT lang, w, f, m, unnest(range(1, len(w) - m + 2)) AS i FROM x),
z AS (SELECT lang, w[i:i + m - 1] AS w, max(f) AS around FROM y GROUP BY 1, 2),
q AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN z ON z.lang = b.lang AND z.w = b.w WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
