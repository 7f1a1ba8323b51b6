"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and of the
words' first letters (BEGINNINGS), so that inflected and compound forms share what they have in common; the
document's score is the noisy-or of its sentences: 1 - prod(1 - p). Only document labels are given; the
gradient of the noisy-or passes them on to the sentences, so the trained model also says which sentences
offend. It is trained in numpy on a bounded sample of labelled documents. BEGINNINGS and the L1 penalty of
fit() were chosen by four folds of the learning rows (crc32 mod 5 from 1 to 4), never by held-out ones.

How it scales: labels are joined to the sampled documents only; scoring is one pass without a shuffle, and
the weights (2^BITS floats) are all that is sent out.

Defined results: null and empty texts have no sentence and score 0. Without learned labels every score
is 0. Repeated label rows count once each in training; repeated documents stay repeated. Sentences end at
. ! ? or a new line; offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm import textbatch
from loanloom.llm.cluster import mapped, only
from loanloom.llm.language_id import held_out

#: Bound of the training sample: documents of either label, each with its whole text.
SAMPLE_PER_LABEL = 2500
BITS = 18
#: Sentences at or above this score offend.
OFFENDS = 0.5
#: Bytes at the beginning of longer words that are features beside the word.
BEGINNINGS = (5, 6)
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """The score of each of n sentences; words: buckets, sentence: the sentence of each."""
        return _logistic(np.bincount(sentence, self.weights[words], n) + self.bias)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: the bucket and the sentence of each word and of each beginning of a word, and of
    each sentence (with a word) the text and the first and last byte."""
    lower = textbatch.LOWER[data]
    starts, ends, _ = textbatch.words(lower, offsets, textbatch.PUNCTUATION)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    sums = textbatch.prefix(lower)
    hashes = [textbatch.span_hashes(sums, starts, ends)]
    breaks = np.cumsum(_END[data])
    text = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    owners = [sentence]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        hashes.append(textbatch.mixed(textbatch.span_hashes(sums, starts[longer], starts[longer] + size) ^ np.uint64(size)))
        owners.append(sentence[longer])
    buckets = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return buckets, np.concatenate(owners), text[first], starts[first], ends[last]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[str], labels: list[int], weights: list[float], rounds: int = 150, sparse: float = 0.0002) -> Model:
    """Minimises the weighted log loss of the noisy-or with Adam; weights undo the sampling of labels.
    An L1 penalty zeroes what tells little, and a leak takes the labels that no sentence explains; it isn't part of
    the model. Features of a single document have weights like any other, if the penalty leaves them one."""
    words, sentence, doc, n_sentences = [], [], [], 0
    for row, data, offsets in textbatch.blocks(pa.array(texts, pa.large_string())):
        b, s, t, _, _ = bags(data, offsets)
        words.append(b)
        sentence.append(s + n_sentences)
        doc.append(t + row)
        n_sentences += len(t)
    words, sentence, doc = np.concatenate(words), np.concatenate(sentence), np.concatenate(doc)
    y, importance = np.array(labels, float), np.array(weights, float)
    importance /= importance.sum()
    used, column = np.unique(words, return_inverse=True)
    theta = np.zeros(len(used) + 2)  # weights, sentence bias, leak
    theta[-2:] = -6.0, -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        p = np.clip(_logistic(np.bincount(sentence, theta[column], n_sentences) + theta[-2]), 1e-12, 1 - 1e-9)
        leak = _logistic(theta[-1])
        clean = (1 - leak) * np.exp(np.bincount(doc, np.log1p(-p), len(texts)))
        blame = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * importance
        dz = blame[doc] * p
        g = np.concatenate([np.bincount(column, dz[sentence], len(used)), [dz.sum(), blame.sum() * leak]])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        rate = 0.1 / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        theta -= rate * (m / (1 - 0.9**step))
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - rate[:-2] * sparse, 0)
    w, bias = theta[:-2], theta[-2]
    full = np.zeros(1 << BITS)
    full[used] = w
    return Model(full, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Learns labels.toxic from the rows that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return None
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.2 * per_label / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, 1.2 * per_label / max(1, counts.get(0, 0)))))
    picked = known.where(order < share * F.lit(1 << 30)).orderBy(order, "doc_id").limit(3 * per_label)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(4 * per_label).collect()
    if not rows:
        return None
    taken = {k: sum(r["toxic"] == k for r in rows) for k in (0, 1)}
    weight = {k: counts.get(k, 0) / max(1, taken[k]) for k in (0, 1)}
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], [weight[r["toxic"]] for r in rows])


def _each(model: Model | None, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block of texts: its first row, the texts' scores, the sentences' scores, texts, begins and ends,
    and the block."""
    for row, data, offsets in textbatch.blocks(column):
        words, sentence, text, begin, end = bags(data, offsets)
        p = model.sentences(words, sentence, len(text)) if model is not None and len(text) else np.zeros(len(text))
        clean = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(offsets) - 1)
        yield row, 1 - np.exp(clean), p, text, begin, end, data, offsets


def _spans(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of byte places within their texts."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    origin = points[offsets[text]]
    return points[begin] - origin, points[end] - origin


def _located(p: np.ndarray, text: np.ndarray, whole: np.ndarray, least: float) -> np.ndarray:
    """Places of the sentences of at least that score and, of texts that count as toxic without one (many weak
    sentences together), of the strongest, the first of equal ones."""
    bad = p >= least
    has = np.zeros(len(whole), bool)
    has[text[bad]] = True
    order = np.lexsort((np.arange(len(p)), -p, text))
    strongest = order[np.unique(text[order], return_index=True)[1]]
    bad[strongest[(whole[text[strongest]] >= 0.5) & ~has[text[strongest]]]] = True
    return np.flatnonzero(bad)


def score(docs: DataFrame, model: Model | None, least: float = OFFENDS) -> DataFrame:
    """doc_id, score and offending (the sentences of at least that score, or the strongest of a text of 0.5 or
    more without one, as start:end in code points, comma-joined) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [np.zeros(0)], [""] * batch.num_rows
            for row, whole, p, text, begin, end, data, offsets in _each(sent.value, batch.column(1)):
                scores.append(whole)
                bad = _located(p, text, whole, least)
                if len(bad):
                    starts, ends = _spans(data, offsets, text[bad], begin[bad], end[bad])
                    for k, a, b in zip((row + text[bad]).tolist(), starts.tolist(), ends.tolist(), strict=True):
                        found[k] += f",{a}:{b}" if found[k] else f"{a}:{b}"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(found, pa.string())], ["doc_id", "score", "offending"])

    source = only(docs, "doc_id", "text")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", score double, offending string")


def offending(docs: DataFrame, model: Model | None, least: float = OFFENDS) -> DataFrame:
    """doc_id, start, end (code points) and score of the sentences that offend, as score() lists them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, whole, p, text, begin, end, data, offsets in _each(sent.value, batch.column(1)):
                bad = _located(p, text, whole, least)
                starts, ends = _spans(data, offsets, text[bad], begin[bad], end[bad])
                owner = batch.column(0).take(pa.array(row + text[bad], pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(p[bad], pa.float64())], ["doc_id", "start", "end", "score"])

    source = only(docs, "doc_id", "text")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", start long, end long, score double")
