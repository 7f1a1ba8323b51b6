"""Decontamination by brute force, in chunks, with string ids and other scripts."""

import random

from loanloom.llm import decontaminate

rnd = random.Random(31)
WORDS = ["".join(rnd.choice("bcdfgaeiou") for _ in range(5)) for _ in range(500)]


def prose(n):
    return [rnd.choice(WORDS) for _ in range(n)]


def best_stretch(doc, item):
    """Most equal words of the best scoring stretch on any diagonal, by trying all."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        score = top = hits = 0
        for k, w in enumerate(item):
            if not 0 <= k + shift < len(doc):
                continue
            same = doc[k + shift] == w
            score, hits = score + (1 if same else -decontaminate.SUBSTITUTION), hits + same
            if score <= 0:
                score = hits = 0
            elif score > top:
                top, best = score, max(best, hits)
    return best


def cases():
    items = {f"q{k}": prose(rnd.choice([9, 15, 30, 60])) for k in range(12)}
    docs = {}
    for k in range(60):
        words = prose(80)
        name, item = rnd.choice(list(items.items()))
        part = list(item)
        for at in rnd.sample(range(len(part)), k=rnd.choice([0, 0, 1, len(part) // 10])):
            part[at] = "changed"
        if k % 3:
            words[20:20] = part[: rnd.choice([6, len(part), len(part)])]
        docs[k] = words
    return docs, items


def test_as_by_brute_force(spark, monkeypatch):
    docs, items = cases()
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id string, text string")
    due = {}
    for k, words in docs.items():
        for n, item in items.items():
            hits = best_stretch(words, item)
            if hits >= min(decontaminate.MIN_MATCHED, decontaminate.SHARE_OF_ITEM * len(item)):
                due[k, n] = hits
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.overlaps(table, bench).collect()}
    assert due and set(got) == set(due)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 500)  # several passes
    again = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.overlaps(table, bench).collect()}
    assert again == got
    assert decontaminate.without_benchmark(table, bench).count() == len(docs) - len({k for k, _ in due})


def test_other_scripts_and_odd_rows(spark):
    item = "Élan vital – “Œuvre” naïve Straße ПРИВЕТ мир δέλτα one two three four"
    rows = [(1, "x élan VITAL, «œuvre» naïve straße; привет МИР ΔΈΛΤΑ one two three four y"), (1, "x élan vital œuvre naïve straße привет мир δέλτα one two three four y"), (2, None), (3, ""), (None, item), (4, "élan vital"), (5, "a " * 30_000 + item)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id int, text string")
    found = decontaminate.overlaps(table, bench)
    assert dict(found.dtypes)["item_id"] == "int"
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found.distinct().collect()) == [(0, 7), (1, 7), (5, 7)]
    assert found.where("doc_id = 1").count() >= 2
    assert decontaminate.overlaps(table.where("false"), bench).count() == 0
    assert decontaminate.overlaps(table, bench.where("false")).count() == 0
    assert decontaminate.without_benchmark(table, bench.where("false")).count() == len(rows)
