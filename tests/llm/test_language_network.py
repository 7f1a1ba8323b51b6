"""The language network against plain loops, its gradient against differences, and its training on whole texts."""

import random

import numpy as np

from loanloom.llm import language_id as L

rnd = random.Random(5)


def words(letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(n))


def small_network(seed=3):
    return L.Network.fresh(["aa", "bb", "cc"], np.random.default_rng(seed))


def windows(n, seed=4):
    drawn = np.random.default_rng(seed).integers(1, 256, (n, L.WINDOW + L.WIDEST - 1)).astype(np.uint8)
    drawn[0, 20:] = 0  # a short text
    return drawn


def plain_logits(net, window):
    """One filter, one place and one byte at a time."""
    hidden = []
    filters = [(w, k) for w, n in L.WIDTHS.items() for k in range(n)]
    for f, (width, _) in enumerate(filters):
        best = -np.inf
        for at in range(len(window) - L.WIDEST + 1):
            total = 0.0
            for k in range(width):
                for e in range(L.EMBEDDING):
                    total += float(net.embedding[window[at + k], e]) * float(net.filters[k * L.EMBEDDING + e, f])
            best = max(best, total)
        hidden.append(max(best + float(net.bias[f]), 0.0))
    return [sum(h * float(net.dense[f, c]) for f, h in enumerate(hidden)) + float(net.dense_bias[c]) for c in range(len(net.languages))]


def test_logits_as_plain_convolution():
    net, x = small_network(), windows(2)
    net.bias += np.linspace(-0.5, 0.5, len(net.bias), dtype=np.float32)
    assert np.allclose(net.logits(x), [plain_logits(net, w) for w in x], atol=1e-3)


def loss(net, x, y):
    z = net.logits(x)
    z = z - z.max(axis=1, keepdims=True)
    return float(-(z[np.arange(len(x)), y] - np.log(np.exp(z).sum(axis=1))).mean())


def test_gradient_as_differences():
    net, x, y = small_network(), windows(4), np.array([0, 1, 2, 1])
    for part in ("embedding", "filters", "bias", "dense", "dense_bias"):
        setattr(net, part, getattr(net, part).astype(np.float64))
    found = L.gradient(net, x, y)
    picks = np.random.default_rng(8)
    for part in ("embedding", "filters", "bias", "dense", "dense_bias"):
        table = getattr(net, part)
        live = np.argwhere(np.abs(found[part]) > 1e-6)
        for place in map(tuple, live[picks.permutation(len(live))[:6]]):
            was, step = table[place], 1e-6
            table[place] = was + step
            up = loss(net, x, y)
            table[place] = was - step
            down = loss(net, x, y)
            table[place] = was
            assert np.isclose((up - down) / (2 * step), found[part][place], rtol=1e-3, atol=1e-6), part
    assert not found["embedding"][0].any() and not found["filters"][L.Network.mask() == 0].any()


def test_every_window_of_the_sample_is_trained_on(spark, monkeypatch):
    long = words("vwxyz", 20_000)
    rows = [(k, words("abcde", 60), "aa") for k in range(40)] + [(k, words("vwxyz", 60), "vv") for k in range(40, 80)]
    rows += [(87, long, "vv"), (89, "", "aa"), (83, None, "aa"), (84, words("abcde", 9), None)] + [(86, "repeated row", "rr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    keep = L.learned

    def watched(languages, rounds, seed=7):
        held = [[(w.copy(), y.copy()) for w, y in r] for r in rounds]
        seen.extend(held)
        return keep(languages, held, seed)

    monkeypatch.setattr(L, "learned", watched)
    monkeypatch.setattr(L, "ROUNDS", 2)
    net = L.train(docs)
    learning = {r["doc_id"]: r for r in docs.where(~L.held_out()).where("text != '' and lang is not null").collect()}
    repeats = docs.where(~L.held_out()).where("doc_id = 86").count()
    assert repeats == 50 and 87 in learning, "the fixture's rows fell into the held-out part"
    due = sum(-(-len(r["text"]) // L.WINDOW) for r in learning.values() if r["doc_id"] != 86) + repeats
    assert net.languages == ["aa", "rr", "vv"] and len(seen) == 2
    for batches in seen:
        assert sum(len(w) for w, _ in batches) == due and max(len(w) for w, _ in batches) <= L.BATCH
    one, two = ([w.tobytes() for ws, _ in r for w in ws] for r in seen)
    assert sorted(one) == sorted(two) and one != two


def test_sample_is_bounded_where_ids_repeat(spark):
    """One id holds every row: a hash of the id alone would take all of them."""
    docs = spark.createDataFrame([(86, f"row number {k}", "aa") for k in range(300)], "doc_id long, text string, lang string")
    counted = []
    real = L.labelled_windows
    try:
        L.labelled_windows = lambda sample: counted.append(sample.count()) or real(sample)
        L.train(docs, per_language=7)
    finally:
        L.labelled_windows = real
    assert counted == [7]
