"""The skip-chain field: base patterns by brute force, marginals by enumeration, planted repeats."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from loanloom.llm import personal_data as pd_

rnd = random.Random(23)
WORDS = ["".join(rnd.choice("aeiourstlnmdk") for _ in range(rnd.randint(3, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def card():
    digits = [rnd.randint(0, 9) for _ in range(15)]
    return next(t for k in range(10) if pd_.luhn(t := "".join(map(str, [*digits, k]))))


def digits(n):
    return "".join(str(rnd.randint(0, 9)) for _ in range(n))


def no_card():
    while pd_.luhn(t := digits(16)):
        pass
    return t


def brute(text):
    """The contract's patterns from every place, leftmost and not overlapping within a kind."""
    found = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(number) <= 19 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(number)))) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(number) <= 15:
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_by_brute_force():
    pieces = ["a@b", "a.b@c-d.e.f", "@x.y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "+1 (555) 010-0200", "+", "+12", "4111 1111-1111 1111", "4111111111111111", "0" * 12, "12", " ", ".", "-", "é", "@", "x", "..", "+49.30.1234567", "1..2", "99999999999999999999"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))
        assert pd_.base_spans(text) == brute(text), text


def test_marginals_by_enumeration():
    """On graphs without a loop message passing is exact; with loops it comes near."""
    random_ = np.random.default_rng(4)
    n_labels = pd_.N_LABELS
    for chain, skip, near in (([(0, 1)], [(1, 3)], 1e-6), ([(0, 1), (2, 3)], [(0, 2)], 1e-6), ([(0, 1), (1, 2)], [(0, 2)], 0.05)):
        n = 4
        g = pd_.Graph([(0, 1)] * n, random_.random((n, pd_.N_FEATURES)), np.array([-1, 2, -1, -1]), np.array(chain), np.array(skip), np.ones(len(skip), bool))
        field = pd_.Field(random_.normal(size=(pd_.N_FEATURES, n_labels)) * 0.4, random_.normal(size=(n_labels, n_labels)) * 0.4, np.array([0.3, 0.9]))
        total = np.zeros((n, n_labels))
        for y in itertools.product(range(n_labels), repeat=n):
            if y[1] != 2:
                continue
            z = sum(g.x[k] @ field.node[:, y[k]] for k in range(n)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(0.9 * (y[a] == y[b]) for a, b in skip)
            for k in range(n):
                total[k, y[k]] += np.exp(z)
        exact = total / total.sum(axis=1, keepdims=True)
        assert np.abs(field.marginals(g, rounds=200) - exact).max() < near + 1e-3


def planted(n):
    """Texts with a value, and later another form of it that no pattern finds: (text, values that are due)."""
    out = []
    for k in range(n):
        number, phone, key = card(), f"+{rnd.randint(1, 99)} ({rnd.randint(100, 999)}) {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}", digits(3) + "".join(rnd.choice("abcdef0123456789") for _ in range(37))
        name = f"{rnd.choice(WORDS)}.{rnd.randint(10, 99)}"
        value, other = [(number, f"****{number[-4:]}"), (phone, re.sub("[^0-9]", "", phone)), (f"{name}@mail.example.com", name), (f'token = "{key}"', key)][k % 4]
        noise = f"{prose(5)} {no_card()} {prose(5)} {rnd.randint(1, 40)} {prose(4)} version 2.0. {rnd.randint(1900, 2030)}"
        out.append((f"{prose(10)} {value} {prose(30)} {noise} {prose(8)} {other} {prose(9)}.", other))
    return out


@pytest.fixture(scope="module")
def field():
    return pd_.fit([t for t, _ in planted(300)])


def recall_and_precision(cases, field):
    due = hit = said = 0
    for text, other in cases:
        base = pd_.base_spans(text)
        added = {text[a:b] for a, b, _ in pd_.added_spans(text, base, field)}
        secret = re.search(r'token = "([^"]+)"', text)
        said += len(added)
        hit += len(added & {other, *([secret.group(1)] if secret else [])})
        due += 1
        assert not secret or secret.group(1) in added
    return (hit / due), (hit / max(1, said))


def test_planted_repeats_are_found_through_skip_edges(field):
    cases = planted(200)
    recall, precision = recall_and_precision(cases, field)
    assert recall >= 0.9 and precision >= 0.9
    alone = pd_.Field(field.node, field.chain, np.zeros(2))
    assert recall_and_precision([c for c in cases if "token" not in c[0]], alone)[0] < 0.5 * recall


def test_base_spans_stay_and_do_not_overlap(field):
    for text, _ in planted(80):
        base = pd_.base_spans(text)
        for a, b, _ in pd_.added_spans(text, base, field):
            assert not any(x < b and y > a for x, y, _ in base)


def test_clean_numbers_are_left_alone(field):
    for _ in range(100):
        text = f"{prose(9)} {no_card()} {prose(9)} {rnd.randint(1, 99999)} {prose(3)} 4.0 {prose(3)} {rnd.randint(1900, 2030)}."
        assert pd_.base_spans(text) == [] and pd_.added_spans(text, [], field) == []


def test_long_texts_take_linear_time(field):
    text = "mail a@b.example " + "漢字" * 500_000 + " 7"
    began = time.time()
    base = pd_.base_spans(text)
    assert pd_.added_spans(text, base, field) == [] and len(base) == 1
    assert time.time() - began < 1


def test_rows(spark, field):
    mail = "write to a.1@b.example or A.1@B.EXAMPLE"
    rows = [(1, mail, "x"), (1, mail, "y"), (2, None, "x"), (3, "", None), (4, prose(5), "x"), (None, mail, "x"), (5, prose(50_000) + " 10.0.0.1", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pd_.find(table, field).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [r["n_email"] for r in got if r["doc_id"] in (1, None)] == [2, 2, 2]
    assert by[2]["spans"] == by[3]["spans"] == by[4]["spans"] == "" and by[5]["n_ip"] == 1
    assert pd_.find(table.where("false"), field).count() == 0
    assert pd_.train(table.where("false")).skip.tolist() == pd_.SKIP_PRIOR.tolist()
