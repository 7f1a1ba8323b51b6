"""Phrases against brute force."""

import random
import re
from collections import Counter

import pytest

from loanloom.llm import collocations as c


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {x: v for x, v in f.items() if v >= least}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        if any(g == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in f.items()):
            continue
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, n[lang]))
    out.sort()
    seen, rows = Counter(), []
    for lang, score, a, phrase, left, right, total in out:
        seen[lang] += 1
        if seen[lang] <= top:
            rows.append((lang, seen[lang], phrase.decode(), -a, left, right, total, -score))
    return rows


def texts():
    random.seed(11)
    words = ["alpha", "beta", "gamma", "Delta", "étude", "eta", "theta", "iota"]
    out = []
    for k in range(120):
        t = " ".join(random.choices(words, [9, 7, 5, 3, 2, 2, 1, 1], k=random.randint(0, 60)))
        out.append((random.choice(["en", "de", None]), t.replace("eta ", "eta, ", 2) + random.choice(["", "! one two three four five six.", "\tONE  two\nthree four"])))
    return [*out, ("en", None), ("fr", ""), ("en", " .,;\r\x0b "), ("en", out[0][1]), ("en", out[0][1])]


@pytest.mark.parametrize("limit", [None, 0])
def test_same_as_brute_force(spark, limit):
    """limit 0: groups are joined by a shuffle."""
    rows = texts()
    docs = spark.createDataFrame([(None, lang, t, "x", 1) for lang, t in rows], "doc_id long, lang string, text string, words string, item int")
    got = sorted(tuple(r) for r in c.collocations(docs, 9, 5, 12, limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = brute(rows, 9, 5, 12)
    assert got == sorted(want) and len(want) > 20


def test_chunks_cut_words_nowhere(monkeypatch):
    text = b"one two, three  four five.six\tseven " * 20
    whole = [w for x in c._chunks(text) for w in x]
    for size in (1, 5, 30):
        monkeypatch.setattr(c, "CHUNK", size)
        assert [w for x in c._chunks(text) for w in x] == whole


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert c.collocations(docs).count() == 0
