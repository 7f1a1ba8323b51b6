"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter keeps its maximum over a
window, and a softmax layer turns the maxima into languages. A text is cut into windows of WINDOW bytes that
overlap by the widest filter, all of them are scored in batches, and the windows' logits are averaged by bytes.
It is trained in numpy on a bounded sample of labelled documents (SAMPLE_PER_LANGUAGE of each language; all
languages, however rare) with their whole texts: their windows are stored as a table, and each round of training
reads all of them in minibatches, in another order.

How it scales: training reads the labels once and a sample of the texts; the driver holds a partition of the
sample's windows at a time, however long the texts and however many the languages are. Scoring is one pass without a
shuffle, and the network (a few thousand numbers, and as many for each language as there are filters) is
all that is sent out. A long text is scored window by window; nothing of it is held but its bytes.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text when no
labelled document can be learned from. Of equal logits the first language in alphabetical order wins.
Repeated rows stay repeated; extra columns are ignored by predict() and pass through keep_known(). An
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm import textbatch
from loanloom.llm.cluster import discarded, mapped, only, written

#: Bound of the training sample: labelled documents of a language.
SAMPLE_PER_LANGUAGE = 600
#: Rounds of training over all windows of the sample: as many as make VISITS windows, from 1 to ROUNDS.
ROUNDS, VISITS = 14, 60_000
#: Bytes of a window; a power of two, so that maxima are taken by halving.
WINDOW = 256
#: Windows of a minibatch.
BATCH = 64
WIDTHS = {2: 8, 3: 12, 4: 12}
WIDEST = max(WIDTHS)
EMBEDDING = 8
UNKNOWN = "und"
#: keep_known() rejects documents below this score.
LEAST_SCORE = 0.5


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], random: np.random.Generator) -> Network:
        n = sum(WIDTHS.values())
        normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        net = cls(languages, normal(256, EMBEDDING, scale=0.5), normal(WIDEST * EMBEDDING, n, scale=0.25), np.zeros(n, np.float32), normal(n, len(languages), scale=0.2), np.zeros(len(languages), np.float32))
        net.filters *= cls.mask()
        net.embedding[0] = 0
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Narrower filters have zeros for the last bytes of the widest ones."""
        return np.concatenate([np.repeat((np.arange(WIDEST * EMBEDDING) < w * EMBEDDING)[:, None], n, axis=1) for w, n in WIDTHS.items()], axis=1).astype(np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under the widest filter at each place: (windows * places, width * embedding)."""
        embedded = self.embedding[windows]
        n, size, e = embedded.shape
        places = size - WIDEST + 1
        view = np.lib.stride_tricks.as_strided(embedded, (n, places, WIDEST * e), (*embedded.strides[:2], embedded.strides[2]))
        return np.ascontiguousarray(view).reshape(n * places, WIDEST * e)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        x = (self.columns(windows) @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        while x.shape[1] > 1 and x.shape[1] % 2 == 0:
            half = x.shape[1] // 2
            x = np.maximum(x[:, :half], x[:, half:])
        return np.maximum(x.max(axis=1) + self.bias, 0) @ self.dense + self.dense_bias


def placed(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a block of texts: the text, the first byte and the number of bytes of each."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[text] + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    return text, start, np.minimum(WINDOW, offsets[text + 1] - start)


def windows_at(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the windows at starts, zero from the ends of their texts on; padded: lower-cased bytes and a 0."""
    places = starts[:, None] + np.arange(WINDOW + WIDEST - 1)
    return padded[np.where(places < ends[:, None], places, len(padded) - 1)]


def _padded(data: np.ndarray) -> np.ndarray:
    return np.append(textbatch.LOWER[data], np.uint8(0))


def learned(languages: list[str], rounds: Iterable[Iterable[tuple[np.ndarray, np.ndarray]]], seed: int = 7) -> Network:
    """Trains on rounds of minibatches (windows, places of their languages), some windows cut short, with Adam on
    the cross-entropy."""
    random = np.random.default_rng(seed)
    net = Network.fresh(languages, random)
    parts = ("embedding", "filters", "bias", "dense", "dense_bias")
    first = {p: np.zeros_like(getattr(net, p)) for p in parts}
    second = {p: np.zeros_like(getattr(net, p)) for p in parts}
    step = 0
    for batches in rounds:
        for windows, y in batches:
            short = random.integers(8, 2 * windows.shape[1], len(windows))
            grad = gradient(net, np.where(np.arange(windows.shape[1]) < short[:, None], windows, np.uint8(0)), y)
            step += 1
            for name in parts:
                first[name] += 0.1 * (grad[name] - first[name])
                second[name] += 0.001 * (grad[name] ** 2 - second[name])
                getattr(net, name)[...] -= 0.004 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return net


def gradient(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of windows x with languages y, by each part of the network; the embedding of
    byte 0 (padding) stays zero."""
    columns = net.columns(x)
    conv = (columns @ net.filters).reshape(len(x), -1, net.filters.shape[1])
    where = conv.argmax(axis=1)
    pooled = np.take_along_axis(conv, where[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(pooled, 0)
    logits = hidden @ net.dense + net.dense_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(x)), y] -= 1
    p /= len(x)
    grad = {"dense": hidden.T @ p, "dense_bias": p.sum(axis=0)}
    back = (p @ net.dense.T) * (pooled > 0)
    grad["bias"] = back.sum(axis=0)
    rows = np.arange(len(x))[:, None] * conv.shape[1] + where
    under = columns[rows]  # text, filter, width * embedding
    grad["filters"] = np.einsum("nf,nfk->kf", back, under) * Network.mask()
    to_bytes = back[:, :, None] * net.filters.T[None]
    grad["embedding"] = np.zeros_like(net.embedding)
    byte_at = where[:, :, None] + np.arange(WIDEST)
    under_bytes = x[np.arange(len(x))[:, None, None], byte_at]
    np.add.at(grad["embedding"], under_bytes.ravel(), to_bytes.reshape(*byte_at.shape, EMBEDDING).reshape(-1, EMBEDDING))
    grad["embedding"][0] = 0
    return grad


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 7) -> Network:
    """Trains on all windows of texts in memory, each round in another order."""
    languages = sorted(set(labels))
    random = np.random.default_rng(seed)
    data, offsets = textbatch.buffers(pa.array(texts, pa.large_string()))
    text, start, _ = placed(offsets)
    windows = windows_at(_padded(data), start, offsets[text + 1])
    targets = np.searchsorted(languages, labels)[text]

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = random.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            yield windows[order[at : at + BATCH]], targets[order[at : at + BATCH]]

    return learned(languages, (batches() for _ in range(rounds)), seed)


def labelled_windows(docs: DataFrame) -> DataFrame:
    """lang and window (its bytes, lower-cased) of all windows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in textbatch.blocks(batch.column(0)):
                text, start, _ = placed(offsets)
                padded = _padded(data)
                for at in range(0, len(text), 4096):
                    own = slice(at, at + 4096)
                    windows = windows_at(padded, start[own], offsets[text[own] + 1])
                    each = [w.tobytes() for w in windows]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row + text[own])), pa.array(each, pa.binary())], ["lang", "window"])

    return mapped(docs.select("text", "lang"), run, "lang string, window binary")


def _round(table: DataFrame, languages: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Minibatches of all windows of the table in the order of round k; the driver holds one partition at a time."""
    rows = iter(table.orderBy(F.xxhash64("window", "lang", F.lit(k)), "window", "lang").toLocalIterator())
    while own := list(islice(rows, BATCH)):
        windows = np.frombuffer(b"".join(bytes(r["window"]) for r in own), np.uint8).reshape(len(own), -1)
        yield windows, np.searchsorted(languages, [r["lang"] for r in own])


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Learns from text and non-null lang of the documents that aren't held out. The sample of each language is
    the first per_language of its documents by a hash of id and text (rows that repeat as a whole are drawn together)."""
    usable = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~F.coalesce(held_out(), F.lit(True))).select("text", "doc_id", "lang")
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    order = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    share = F.create_map([x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * per_language / r["count"] + 20 / r["count"])))])
    picked = usable.where(order < F.element_at(share, F.col("lang")) * F.lit(1 << 30))
    # a limit by rank is applied in each task before the shuffle, so repeated rows don't swell a language's group
    first = W.partitionBy("lang").orderBy(order, "doc_id")
    sample = picked.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)
    table = written(labelled_windows(sample), "language-windows")
    found = {r["lang"]: r["count"] for r in table.groupBy("lang").count().collect()}
    if not found:
        return None
    rounds = max(1, min(ROUNDS, -(-VISITS // sum(found.values()))))
    languages = sorted(found)
    net = learned(languages, (_round(table, languages, k) for k in range(rounds)))
    discarded(table)
    return net


def _scored(net: Network | None, column: pa.Array, has_letter: pa.Array) -> tuple[list[str], list[float]]:
    n = len(column)
    names, scores = [UNKNOWN] * n, [0.0] * n
    if net is None:
        return names, scores
    letters = has_letter.to_pylist()
    for row, data, offsets in textbatch.blocks(column):
        total = np.zeros((len(offsets) - 1, len(net.languages)))
        padded = _padded(data)
        text, start, size = placed(offsets)
        for at in range(0, len(text), 64):
            own = slice(at, at + 64)
            part = net.logits(windows_at(padded, start[own], offsets[text[own] + 1])) * size[own, None]
            np.add.at(total, text[own], part)
        total /= np.maximum(np.diff(offsets), 1)[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k in range(len(best)):
            if letters[row + k]:
                names[row + k], scores[row + k] = net.languages[best[k]], float(p[k, best[k]])
    return names, scores


def _with_letter(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _scored(sent.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    source = only(docs, "doc_id", "text")
    schema = source.schema.fields[0].simpleString().replace(":", " ") + ", lang_pred string, score double"
    return mapped(source.select("doc_id", "text", _with_letter(source).alias("letter")), run, schema)


def keep_known(docs: DataFrame, net: Network | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs with a recognised language, all columns; lang is what was predicted. Without a
    network nothing can be rejected for its score, only texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter, columns = batch.column(batch.num_columns - 1), batch.columns[:-1]
            names, scores = _scored(sent.value, batch.column(at), letter)
            if sent.value is None:
                keep = letter
            else:
                keep = pa.array([s >= least_score for s in scores], pa.bool_())
                columns[lang_at] = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_columns).filter(keep)

    docs_columns = docs.columns
    return mapped(docs.select(*[docs[c] for c in docs.columns], _with_letter(docs)), run, docs.schema)
