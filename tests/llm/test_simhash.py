"""SimHash groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from loanloom.llm import simhash


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    """rows: (doc_id, fingerprint) -> component of each."""
    label = [d for d, _ in rows]
    todo = True
    while todo:
        todo = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], todo = label[j], True
    return label


def test_same_as_brute_force(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "x y"]
    texts = [" ".join(random.choices(words, k=random.choice([1, 2, 3, 40, 150]))) for _ in range(60)]
    texts += [" ".join(t.split()[:-1]) for t in texts[:30]] + [t.upper().replace(" ", " \t\n") for t in texts[:10]] + [None, "", " \n ", texts[5]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, fp int, label string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(prints, groups(prints), strict=True)}
    assert got[101][1] == got[100][1]  # empty and blank texts have fingerprint zero


@pytest.mark.parametrize("members", [8, 64, 4096])
def test_dense_buckets_are_divided_and_tiled(spark, members):
    """Many fingerprints that differ in few bits, and some far from all."""
    rng = np.random.default_rng(members)
    centers = rng.integers(0, 1 << 63, 12)
    prints = {int(c) for c in rng.integers(0, 1 << 63, 100)}
    for c in centers.tolist():
        for _ in range(25):
            for b in rng.choice(63, rng.integers(0, 9), replace=False).tolist():
                c = c ^ (1 << b) if rng.random() < 0.5 else c
            prints.add(c)
    rows = list(enumerate(sorted(prints)))
    random.Random(1).shuffle(rows)
    got = simhash.grouped(spark.createDataFrame(rows, "doc_id long, fp long"), members)
    want = dict(zip([d for d, _ in rows], groups(rows), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_bit_sliced_edges_join_what_plain_distances_join():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(int(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))) for k in (0, 1, 2, 3, 4, 5)]))
    for first in ([0, len(fps)], [0, 1, 3, 70, 71, len(fps)]):
        a, b = simhash.compared(fps, np.array(first))
        label = simhash._roots(len(fps), a, b, np.arange(len(fps)))
        for lo, hi in zip(first, first[1:]):
            want = groups([(k, int(fps[k])) for k in range(lo, hi)])
            assert label[lo:hi].tolist() == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "q " * 70000), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (7, 7), (7, 7), (9, 9), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
