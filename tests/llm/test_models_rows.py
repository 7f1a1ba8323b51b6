"""Learned models and encoders on odd rows: null, empty, long and repeated texts, empty tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm import byte_bpe, language_id, textbatch, token_counts, toxicity

rnd = random.Random(41)


def words(letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def network():
    texts = [words("abcde", 60) for _ in range(60)] + [words("vwxyz", 60) for _ in range(60)] + [words("mnopq", 300) for _ in range(3)]
    return language_id.fit(texts, ["aa"] * 60 + ["vv"] * 60 + ["mm"] * 3, rounds=8)


def test_language_of_odd_rows(spark, network):
    long = words("vwxyz", 60_000)
    rows = [(1, words("abcde", 40), "x"), (1, words("abcde", 40), "x"), (2, long, "x"), (3, None, "x"), (4, "", "x"), (5, "12 34 !?", "x"), (None, words("abcde", 40), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = language_id.predict(table, network).collect()
    assert len(got) == len(rows) and network.languages == ["aa", "mm", "vv"]
    by = {r["doc_id"]: (r["lang_pred"], r["score"] > 0.5) for r in got}
    assert by == {1: ("aa", True), 2: ("vv", True), 3: ("und", False), 4: ("und", False), 5: ("und", False), None: ("aa", True)}
    assert language_id.predict(table.where("false"), network).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(table, None).collect()} == {"und"}


def test_known_languages_stay(spark, network):
    table = spark.createDataFrame([(1, words("abcde", 40), "zz", "s"), (2, None, "aa", "s"), (3, "77", "aa", "s")], "doc_id long, text string, lang string, source string")
    kept = language_id.keep_known(table, network).collect()
    assert [(r["doc_id"], r["lang"]) for r in kept] == [(1, "aa")]
    assert language_id.keep_known(table.where("false"), network).count() == 0
    assert sorted(r["doc_id"] for r in language_id.keep_known(table, None).collect()) == [1]


def test_windows_cover_whole_texts():
    data = np.frombuffer(words("abc", 400).encode(), np.uint8)
    offsets = np.array([0, 0, 300, len(data)])
    text, start, size = language_id.placed(offsets)
    for k in (1, 2):
        own = text == k
        assert size[own].sum() == offsets[k + 1] - offsets[k] and start[own][0] == offsets[k]
    assert not (text == 0).any()


def test_toxicity_of_odd_rows(spark):
    clean, bad = [words("abcde", 8) + "." for _ in range(80)], ["scumwort", "scumworts", "scumwortig"]
    texts = [f"{rnd.choice(clean)} You {rnd.choice(bad)}! {rnd.choice(clean)}" if k % 2 else f"{rnd.choice(clean)} {rnd.choice(clean)}" for k in range(160)]
    model = toxicity.fit(texts, [k % 2 for k in range(160)], [1.0] * 160)
    long = " ".join(clean)
    rows = [(1, "Fine day. Né scumwortex! Fine."), (1, "Fine day. Né scumwortex! Fine."), (2, long), (3, None), (4, ""), (5, "..!?"), (None, "fine day"), (6, long + " You scumwort!")]
    table = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, offending string")
    got = toxicity.score(table, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[1]["score"] > 0.5 and by[6]["score"] > 0.5  # a form never seen, by its beginning
    assert all(by[k]["score"] < 0.5 and by[k]["offending"] == "" for k in (2, 3, 4, 5, None))
    start, end = map(int, by[1]["offending"].split(":"))
    assert "scumwortex" in rows[0][1][start:end] and by[3]["score"] == 0
    spans = toxicity.offending(table, model).collect()
    assert sorted((r["doc_id"], f"{r['start']}:{r['end']}") for r in spans) == sorted((r["doc_id"], s) for r in got for s in r["offending"].split(",") if s)
    assert toxicity.score(table.where("false"), model).count() == 0 == toxicity.offending(table.where("false"), model).count()
    assert {r["score"] for r in toxicity.score(table, None).collect()} == {0.0}
    assert toxicity.train(table, spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_encoders_on_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(empty).count() == byte_bpe.decode(byte_bpe.encode(empty)).count() == token_counts.counted(empty).count() == 0


def test_long_pretokens_as_short_ones(monkeypatch):
    scores = token_counts.piece_scores(token_counts.vocabulary_path())
    word = ("abcdefgh" * 60).encode()
    short = token_counts.UnigramTrie(scores)
    due = token_counts.UnigramTrie(scores)
    monkeypatch.setattr(token_counts, "LONGEST", 10_000)
    inside = due.insert(word)
    monkeypatch.setattr(token_counts, "LONGEST", 16)
    assert short.insert(word) == inside


def test_pieces_are_bounded_in_bytes():
    texts = ["x" * n for n in (10, 500, 20, 5000, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    got = [p.column(0).to_pylist() for p in textbatch.pieces(iter([batch]), rows=3, size=600)]
    assert sum(got, []) == list(range(len(texts))) and [3] in [g for g in got if 3 in g]
    assert all(len(g) <= 3 and (len(g) == 1 or sum(len(texts[k] or "") for k in g) <= 600) for g in got)
    assert [*textbatch.pieces(iter([batch.slice(0, 0)]))] == []
