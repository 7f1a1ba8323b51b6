"""Matching by brute force, and tables written and read back."""

import json
import random

import pytest

from loanloom.operators import matching
from loanloom.sources import records
from loanloom.streaming import listings as stream_listings

rnd = random.Random(3)
FIELDS = "listing_id long, source string, city string, locality string, bedrooms int, area_sqft double, price_inr double, price_per_sqft double, property_type string, bathrooms int, furnishing string, floor int, total_floors int, property_age int, parking int, pincode string, listing_age_days int"


def listing(k, source):
    pick = rnd.choice
    return (k, source, "x", pick(["Lake View", "lake view.", "Hill", "Hill Top", None, ""]), pick([1, 2, 3, None]), pick([600.0, 640.0, 900.0, 0.0, None]), pick([5e6, 5.2e6, 9e6, None]), None, "Apartment", pick([None, 0, 2]), pick([None, " ", "Furnished"]), None, 4, None, 1, None, 10)


def score(a, b):
    clean = lambda t: " ".join("".join(c for c in (t or "").lower().strip() if c.isalnum() or c.isspace()).split())
    parts, p, q = [], clean(a[3]), clean(b[3])
    if p and q:
        words = len(set(p.split()) & set(q.split())) / max(len(set(p.split())), len(set(q.split())))
        parts.append((1.0 if p == q else 0.7 if p in q or q in p else 0.3 * words, 0.5))
    for k, w in ((5, 0.25), (6, 0.10)):
        if a[k] and b[k]:
            parts.append((min(a[k], b[k]) / max(a[k], b[k]), w))
    if a[4] is not None and b[4] is not None:
        parts.append((1.0 if a[4] == b[4] else 0.3 if abs(a[4] - b[4]) == 1 else 0.0, 0.15))
    if not parts:
        return 0.0
    base = sum(s * w for s, w in parts) / sum(w for _, w in parts)
    if a[4] is not None and b[4] is not None and a[4] != b[4]:
        base *= 0.5
    if p and q and p != q:
        base *= 0.6
    return round(base, 3)


def test_candidates_and_assignment(spark):
    left, right = [listing(k, "a") for k in range(40)], [listing(100 + k, "b") for k in range(40)]
    due = {(a[0], b[0]): s for a in left for b in right if (s := score(a, b)) >= 0.6}
    pairs = matching.candidates(spark.createDataFrame(left, FIELDS), spark.createDataFrame(right, FIELDS))
    got = {(r["a"], r["b"]): r["score"] for r in pairs.collect()}
    assert set(got) == set(due) and all(abs(got[k] - due[k]) < 2e-3 for k in due)
    used, chosen = set(), set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in got.items()), reverse=True):
        if a not in used and b not in used:
            chosen.add((a, b))
            used |= {a, b}
    assert {(r["a"], r["b"]) for r in matching.assigned(pairs).collect()} == chosen
    assert matching.assigned(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        matching.candidates(pairs, pairs, 0.5)


def test_merging_fills_what_is_empty(spark):
    rows = [(1, "a", "x", "Hill", 2, 600.0, 5e6, None, "Apartment", None, " ", None, 4, None, 1, None, 10), (2, "a", "x", "Lake", 1, 900.0, 9e6, None, "Villa", 1, "Furnished", None, 4, None, 1, None, 10), (11, "b", "x", "hill", 2, 610.0, 5e6, None, "Plot", 2, "Furnished", 3, 0, None, 0, "560001", 10), (12, "b", "x", "Far", 3, 100.0, 1e6, None, "Plot", 2, None, None, None, None, None, None, 10)]
    got = {r["listing_id"]: r for r in matching.merged(spark.createDataFrame(rows, FIELDS), ["a", "b"]).collect()}
    assert set(got) == {1, 2, 12}
    r = got[1]
    assert (r["sources"], r["source_count"], r["bathrooms"], r["furnishing"], r["floor"], r["pincode"], r["property_type"]) == (["a", "b"], 2, 2, "Furnished", 3, "560001", "Apartment")
    assert r["imputed_fields"] == ["pincode", "bathrooms", "furnishing", "floor"]
    assert got[2]["sources"] == ["a"] and got[12]["sources"] == ["b"]


def test_exports_in_three_forms(spark, tmp_path):
    data = [{"id": "1", "gender": "F"}, {"id": "2", "gender": None}]
    forms = {"array": json.dumps(data, indent=1), "lines": "\n".join(map(json.dumps, data)) + "\n\n", "one": json.dumps(data[0]), "wide": json.dumps(data[0], indent=2), "bom": "﻿" + "\n".join(map(json.dumps, data)), "empty": "\n"}
    for name, text in forms.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        got = sorted(r["id"] for r in records.rows(spark, str(path), "id string, gender string").collect())
        assert got == {"one": ["1"], "wide": ["1"], "empty": []}.get(name, ["1", "2"]), name


def test_cases_with_bad_rows(spark, tmp_path):
    item = "application_id: string, ground_truth_decision: string"
    good = [{"application_id": "1", "ground_truth_decision": "DENY"}, {"application_id": "2"}]
    for name, content in (("bare", good), ("cases", {"cases": good}), ("labelled", {"labeled_cases": good})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content))
        kept, bad = records.cases(spark, str(path), item)
        assert [r["application_id"] for r in kept.collect()] == ["1"]
        assert [(r["place"], r["application_id"]) for r in bad.collect()] == [(1, "2")]


def test_listing_file(spark, tmp_path):
    path = tmp_path / "listings.csv"
    path.write_text("source_platform,listing_url,city,property_type,bhk,area_sqft,price_inr,unknown\nhousing,u1,bangalore,residential flat,2.0,900,5000000,x\n,,pune,row house,99999999999,n/a,,x\n")
    got = records.mapped(records.listing_file(spark, str(path))).collect()
    assert (got[0]["city"], got[0]["property_type"], got[0]["bedrooms"], got[0]["area_sqft"]) == ("Bengaluru", "Apartment", 2, 900.0)
    assert (got[1]["source"], got[1]["city"], got[1]["property_type"], got[1]["bedrooms"], got[1]["area_sqft"], got[1]["price_inr"]) == ("unknown", "Pune", "Independent House", None, None, None)


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(1, "APPROVE", "2024-01-01 10:00:00"), (2, "DENY", "2024-01-02 10:00:00")], "application_id long, decision string, t string").selectExpr("application_id", "decision", "cast(t as timestamp) ts")
    path = str(tmp_path / "audit")
    records.append_audit(log, path)
    records.append_audit(log.where("application_id = 1"), path)
    assert records.audit(spark, path).count() == 3 and records.audit(spark, path, 1).count() == 2
    text = records.save_report(spark.createDataFrame([("a", 1), ("b", None)], "k string, n int"), str(tmp_path / "report"))
    assert text.splitlines()[0] == "| k | n |" and spark.read.json(str(tmp_path / "report")).count() == 2
    records.save_scores(spark.createDataFrame([(1.5,), (None,)], "s double"), "s", str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 1


def test_streamed_appends(spark, tmp_path):
    schema = "listing_id long, source_url string"
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], schema).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream_listings.append_stream(spark.readStream.schema(schema).parquet(source), table, mark).awaitTermination(120)
        assert sorted(r[0] for r in spark.read.parquet(table).collect()) == [1, 3]
    spark.createDataFrame([(4, "a"), (5, "b")], schema).write.mode("append").parquet(source)
    stream_listings.append_stream(spark.readStream.schema(schema).parquet(source), table, mark).awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(table).collect()) == [1, 3, 5]


def greedy(rows):
    used, chosen = set(), set()
    for s, a, b in sorted(((s, a, b) for a, b, s in rows), reverse=True):
        if ("a", a) not in used and ("b", b) not in used:
            chosen.add((a, b))
            used |= {("a", a), ("b", b)}
    return chosen


def test_assignment_of_a_long_chain(spark):
    """Each pair is better than the one before it and shares an end with it: by rounds that would take 500 of them."""
    rows = [(i // 2 + i % 2, i // 2, 0.6 + i / 10000) for i in range(1000)]
    pairs = spark.createDataFrame(rows, "a long, b long, score double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert {(r["a"], r["b"]) for r in matching.assigned(pairs).collect()} == greedy(rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 300


@pytest.mark.parametrize("most", [1000, 6])
def test_assignment_by_components_and_by_rounds(spark, most):
    """Components of more than most pairs are taken by rounds; repeated pairs count once, nulls take no part."""
    rows = [(rnd.randrange(40), rnd.randrange(40), round(rnd.random(), 1)) for _ in range(60)]
    best = {}
    for a, b, s in rows:
        best[a, b] = max(s, best.get((a, b), 0))
    odd = [(None, 1, 0.9), (1, None, 0.9), (1, 1, None)]
    pairs = spark.createDataFrame([*rows, *odd], "a long, b long, score double")
    assert {(r["a"], r["b"]) for r in matching.assigned(pairs, most).collect()} == greedy([(a, b, s) for (a, b), s in best.items()])


def _many(spark, seed):
    """Two sides of listings with many equal scores, some without locality or bedrooms."""
    rnd = random.Random(seed)
    rows = [(k, rnd.choice("XY"), rnd.choice(("L1", "L2", None)), rnd.choice((1, 2, None)), float(rnd.choice((600, 620, 900))), rnd.choice((None, 1e6, 2e6))) for k in range(160)]
    df = spark.createDataFrame(rows, "listing_id long, city string, locality string, bedrooms int, area_sqft double, price_inr double")
    return df.where("listing_id % 2 = 0"), df.where("listing_id % 2 = 1")


def test_matched_without_a_table_of_pairs(spark):
    a, b = _many(spark, 5)
    pairs = [(r["a"], r["b"], r["score"]) for r in matching.candidates(a, b).collect()]
    left, right, greedy = set(), set(), []
    for x, y, score in sorted(pairs, key=lambda p: (-p[2], -p[0], -p[1])):
        if x not in left and y not in right:
            left.add(x), right.add(y), greedy.append((x, y, score))
    for few in (len(pairs) // 3, len(pairs)):  # some rounds before the rest is walked; none
        assert sorted(tuple(r) for r in matching.matched(a, b, few=few).select("a", "b", "score").collect()) == sorted(greedy)
    mutual = sorted(tuple(r) for r in matching.best_of_both(matching.candidates(a, b)).collect())
    assert sorted(tuple(r) for r in matching.mutual_best(a, b).select("a", "b", "score").collect()) == mutual


def test_best_pairs_are_found_without_sorting_them(spark):
    a, b = _many(spark, 6)
    plan = matching._best(matching.candidates(a, b))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_ids_that_do_not_fit_beside_a_score(spark):
    a, b = _many(spark, 7)
    far = a.withColumn("listing_id", a["listing_id"] + matching.IDS)
    plain = {(r["a"], r["b"]) for r in matching.matched(a, b).collect()}
    assert {(r["a"] - matching.IDS, r["b"]) for r in matching.matched(far, b).collect()} == plain
