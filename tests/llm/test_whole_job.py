"""Cases in which the text operators did less than the whole job."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanloom.llm import byte_bpe, decontaminate, language_id, near_dedup, personal_data, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(11)
WORDS = ["".join(rnd.choice("klmnopqrst") for _ in range(6)) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def test_short_benchmark_items(spark):
    items = {1: "who won", 2: "what is the capital of far atlantis", 3: "which river runs through the old town", 4: "why", 5: "one two three four five six"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(1, f"{prose(30)} WHO won? {prose(5)}"), (2, items[2]), (3, prose(9) + " Which river runs through the old city " + prose(9)), (4, prose(3) + " why"), (5, "two three four five six, " + prose(20)), (6, "who has won"), (7, "three four five six one two"), (8, "what is the capital of near atlantis")]
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): 2, (2, 2): 7, (3, 3): 6, (4, 4): 1, (5, 5): 5}
    assert sorted(r["doc_id"] for r in decontaminate.without_benchmark(docs(spark, rows), bench).collect()) == [6, 7, 8]


def test_models_learn_from_whole_texts(spark, monkeypatch):
    """The last word of a text of more than 20,000 characters is in the training sample of each model."""
    table = docs(spark, [(k, prose(3000) + f" 12{k} lastword") for k in range(12)])
    seen = []
    for module in (personal_data, toxicity):
        monkeypatch.setattr(module, "fit", lambda texts, *rest: seen.append(texts))
    windows = []
    monkeypatch.setattr(language_id, "learned", lambda languages, rounds: windows.extend(w.tobytes().rstrip(b"\0").decode() for batch, _ in next(iter(rounds)) for w in batch))
    language_id.train(table)
    ends = {w for w in windows if len(w) < language_id.WINDOW and "lastword".endswith(w[-8:])}
    learning = table.where(~language_id.held_out()).count()
    assert len(ends) == learning and len(windows) > learning * 20_000 // language_id.WINDOW
    seen.append([r["text"] for r in table.collect() if any(r["text"].endswith(w) for w in ends)])
    personal_data.train(table)
    toxicity.train(table, spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int"))
    assert len(seen) == 3 and all(texts and all(t.endswith("lastword") for t in texts) for texts in seen)


def test_rare_toxic_words_are_learned():
    """A word in 5 of 1,500 documents, all of them toxic, gets a weight."""
    texts = [prose(8) + "." for _ in range(1500)]
    toxic = [int(k % 50 == 0) for k in range(1500)]
    for k in range(0, 1500, 50):
        texts[k] += " you scumword." if k < 250 else " you badword."
    model = toxicity.fit(texts, toxic, [1.0] * len(texts))
    scores = [float(x[1][0]) for t in ("fine day. you scumword.", "fine day. you badword.", "fine day. you.") for x in toxicity._each(model, pa.array([t]))]
    assert scores[0] > 0.5 and scores[1] > 0.5 > scores[2]


def test_texts_that_share_an_id(spark):
    """Different texts of one doc_id are documents of their own; rows equal in id and class are one."""
    a, b, c, d = prose(80), prose(80), prose(80), prose(80)
    near = lambda t: t.replace(t.split()[40], "changed", 1)
    rows = [(1, a), (2, near(a)), (2, b), (2, b), (3, c), (3, near(c)), (4, d), (5, d), (5, near(b)), (6, None), (6, None), (6, c + prose(60)), (None, a), (None, a)]
    kept = near_dedup.one_of_each(docs(spark, rows), 5, 80)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(1, a), (2, b), (3, c), (4, d), (6, None), rows[11], (None, a), (None, a)]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    first = min((near_dedup._digest(next(near_dedup._sets(pa.array([t], pa.large_string()), 5))), t) for t in (c, near(c)))[1]
    assert sorted(got, key=key) == sorted([x if x != (3, c) else (3, first) for x in want], key=key)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows), 5, 80).collect()}
    assert {(2, 76, 1, False), (2, 76, 2, True), (5, 76, 4, False), (5, 76, 2, False), (3, 76, 3, True), (3, 76, 3, False), (6, 0, 6, True)} <= found


def test_pipeline_decodes_what_it_encodes(spark, monkeypatch):
    import corpus_pipeline

    table = docs(spark, [(1, "ÀÉ é e\u0301 漢字 😀 <|endoftext|> don't\r\n\0"), (2, None), (None, ""), (2, prose(50))])
    got = corpus_pipeline.tokens(spark, table, "")
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.schema["doc_id"].dataType.simpleString() == "bigint"
    want = sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in byte_bpe.encode(table).collect())
    chained = sorted((r["doc_id"] or 0, bytes(r["ids"]), r["text"]) for r in byte_bpe.decode(byte_bpe.encode(table)).collect())
    assert chained == sorted((r["doc_id"] or 0, bytes(r["ids"]), r["text"]) for r in byte_bpe.round_trip(table).collect())
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in got.collect()) == want
    both = byte_bpe.round_trip
    monkeypatch.setattr(byte_bpe, "round_trip", lambda x: both(x).withColumn("text", F.concat("text", F.lit("x"))))
    with pytest.raises(Exception, match="decoded text differs"):
        corpus_pipeline.tokens(spark, table, "").collect()
