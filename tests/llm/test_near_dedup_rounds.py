"""Near dedup against brute force where buckets hold many documents that no link joins, so that it takes many rounds."""

import random

import pytest

from loanloom.llm import near_dedup


def brute_force(texts, words, percent):
    sets = {}
    for i, text in texts.items():
        said = text.split()
        sets[i] = {tuple(said[k : k + words]) for k in range(len(said) - words + 1)} or ({tuple(said)} if said else set())
    least = {i: i for i in texts}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                a2, b2 = sorted((top(a), top(b)))
                least[b2] = a2
    return {i: top(i) for i in texts}


def family(seed, size, changed):
    """Variants of one text, each with some words replaced; far variants share buckets and aren't linked."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for k in range(size):
        said = list(base)
        for _ in range(changed(k)):
            said[rng.randrange(len(said))] = f"x{rng.randrange(10**6)}"
        yield " ".join(said)


@pytest.mark.parametrize("broadcast", [near_dedup.BROADCAST_BYTES, 0])
def test_many_rounds_as_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(near_dedup, "ROWS", 1)  # one value a band: buckets of documents that are hardly alike
    monkeypatch.setattr(near_dedup, "STEP", 3)
    monkeypatch.setattr(near_dedup, "RARE_ROUND", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", broadcast)
    texts = [*family(1, 30, lambda k: k % 7), *family(2, 12, lambda k: 6), *family(3, 5, lambda k: 1), "", "w1 w2"]
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, 3, 85).collect()
    due = brute_force(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in found} == due
    assert {r["doc_id"]: r["kept"] for r in found} == {i: i == c for i, c in due.items()}
    assert 10 < len(set(due.values())) < len(texts) - 5
