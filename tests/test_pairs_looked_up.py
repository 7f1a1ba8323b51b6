"""Assignment by looking partners up, against a walk through all pairs; cities that are joined by an id; cities by rounds."""

import random

import numpy as np
import pytest

from loanloom.operators import matching, pairing
from pyspark.sql import functions as F

FIELDS = "listing_id long, city string, locality string, bedrooms int, area_sqft double, price_inr double"


def some(rnd, n, alike, first=0):
    """Rows of listings with few or many different areas and prices, some without any of their fields."""
    area = (lambda: rnd.choice((600.0, 620.0, 900.0))) if alike else (lambda: round(rnd.uniform(300, 3000), 2))
    price = (lambda: rnd.choice((1e6, 2e6))) if alike else (lambda: round(rnd.uniform(1e6, 9e6), 1))
    part = lambda make: make() if rnd.random() < 0.9 else rnd.choice((None, 0.0))
    return [(first + k, rnd.choice("XY"), rnd.choice(("L1", "l1.", "L2", None)), rnd.choice((1, 2, None)), part(area), part(price)) for k in range(n)]


def walked(pairs):
    left, right, out = set(), set(), []
    for a, b, score in sorted(pairs, key=lambda p: (p[2], p[0], p[1]), reverse=True):
        if a not in left and b not in right:
            left.add(a), right.add(b), out.append((a, b, score))
    return sorted(out)


def best_pairs(pairs):
    best = {}
    for a, b, score in pairs:
        best[a, b] = max(score, best.get((a, b), 0.0))
    return [(a, b, score) for (a, b), score in best.items()]


@pytest.mark.parametrize(("n", "m", "alike"), [(150, 60, True), (60, 150, True), (120, 120, False), (90, 200, False)])
def test_looked_up_pairs_are_those_of_a_walk(spark, monkeypatch, n, m, alike):
    monkeypatch.setattr(pairing, "NEAR", 2)  # windows that end before all is seen
    monkeypatch.setattr(pairing, "KEPT", 3)
    rnd = random.Random(n + m + alike)
    a, b = some(rnd, n, alike), some(rnd, m, alike, 1000)
    pairs = [tuple(r) for r in matching.candidates(spark.createDataFrame(a, FIELDS), spark.createDataFrame(b, FIELDS)).collect()]
    rows = [(side, *r) for side, found in ((0, a), (1, b)) for r in found]
    place = {"l1": 0, "l2": 1}
    column = lambda f, kind: np.array([f(r) for r in rows], kind)
    x, y, x_ids, y_ids = pairing.sides(
        column(lambda r: r[0], np.int64), column(lambda r: r[1], np.int64), column(lambda r: "XY".index(r[2]), np.int64),
        column(lambda r: place.get((r[3] or "").lower().strip("."), -1), np.int64), column(lambda r: -1 if r[4] is None else r[4], np.int64),
        column(lambda r: r[5] or 0.0, float), column(lambda r: r[6] or 0.0, float),
    )
    left, right, score = pairing.assigned(x, y, len(x_ids), len(y_ids), 0.6)
    assert sorted(zip(x_ids[left].tolist(), y_ids[right].tolist(), (score / 1000.0).tolist(), strict=True)) == walked(pairs)


def test_thousandths_are_those_of_matching(spark):
    rnd = random.Random(4)
    values = [rnd.random() for _ in range(5000)] + [k / 2000 + d for k in range(2001) for d in (0.0, -1e-7, -6e-11, -4e-11, 4e-11, 1e-7) if k] + [float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", matching._thousandths(F.col("x")).alias("y")).collect()
    with np.errstate(invalid="ignore"):
        assert (pairing.thousandths(np.array([r["x"] for r in rows])) / 1000.0).tolist() == [r["y"] for r in rows]


@pytest.mark.parametrize("few", [1000, 40])
def test_matched_with_repeated_ids(spark, few):
    """Ids repeat, within a city and in two; their rows have one partner together. Cities of over 40 go by rounds."""
    rnd = random.Random(few)
    a, b = ([(r[0] // 2, *r[1:]) for r in some(rnd, 140, True)] for _ in range(2))
    a, b = spark.createDataFrame([*a, *a[:5], (None, "X", "L1", 1, 600.0, 1e6)], FIELDS), spark.createDataFrame(b, FIELDS)
    due = walked(best_pairs(tuple(r) for r in matching.candidates(a, b).where("a is not null").collect()))
    assert sorted(tuple(r) for r in matching.matched(a, b, few=few).collect()) == due


def test_matched_makes_no_table_of_pairs(spark):
    """A city of listings that all suit each other has 9,000,000 pairs; those taken are found without them."""
    side = lambda first: spark.range(3000).select((F.col("id") + first).alias("listing_id"), F.lit("X").alias("city"), F.lit("L").alias("locality"), F.lit(2).alias("bedrooms"), (500.0 + F.col("id")).alias("area_sqft"), F.lit(1e6).alias("price_inr"))
    asked = []
    watched = matching._pairs
    try:
        matching._pairs = lambda *a: asked.append(a) or watched(*a)
        got = matching.matched(side(0), side(10_000)).collect()
    finally:
        matching._pairs = watched
    assert not asked
    assert sorted((r["a"], r["b"], r["score"]) for r in got) == [(k, 10_000 + k, 1.0) for k in range(3000)]
    assert matching.matched(side(0).limit(0), side(1)).count() == 0
