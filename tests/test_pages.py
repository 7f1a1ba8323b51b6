"""Structured data, configurations and localities of pages, read by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loanloom.operators import pages

LD = '<script type="application/ld+json">{}</script>'
NEXT = '<script id="__NEXT_DATA__" type="application/json">{}</script>'


@pytest.mark.parametrize("html,want", [
    (LD.format('{"a": {"b": 1, "c": [1, {"d": 2}]}}') + LD.format('{"a": {"c": {"e": 3}, "f": null}, "g": "x"}'), {"a": {"b": 1, "c": {"e": 3}, "f": None}, "g": "x"}),
    (LD.format('{"a": 1}') + LD.format('{"a": {"b": 2}}') + LD.format('{"a": {}}'), {"a": {"b": 2}}),
    (LD.format('{"a": {"b": 2}}') + LD.format('{"a": 5}'), {"a": 5}),
    (LD.format('[{"a": 1}, 7, {"b": {"c": 2}}]'), {"a": 1, "b": {"c": 2}}),
    (LD.format('{"a": 1}\n{"b": 2} {"a": 3}'), {"a": 3, "b": 2}),
    (LD.format('{"a": }') + LD.format("nothing") + LD.format("  ") + LD.format('"text"'), {}),
    (NEXT.format("[1]") + NEXT.format('{"p": {"q": 1}}') + NEXT.format('{"p": 2}') + LD.format('{"p": {"r": 0}}'), {"p": {"r": 0, "q": 1}}),
    (LD.format('{"x": {"y": 1}}') + '<script>let a = 1; window.__NUXT__ = {"x": {"y": 2, "z": {"é": "₹"}}};</script>', {"x": {"y": 2, "z": {"é": "₹"}}}),
    ("<p>none</p>", {}), (None, {}),
])
def test_merged(spark, html, want):
    found = pages.merged_data(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert json.loads(found["data"]) == want


def test_chunks(spark):
    texts = {'{"a":{"b":1}}{"c":2} tail': ['{"a":{"b":1}}', '{"c":2}'], "no brace": ["no brace"], '[{"a":1},[{"b":2}]]': ['{"a":1}', '{"b":2}'], '{"open": {': ['{"open": {'], "": [""]}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.json_chunks(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == texts


def test_configurations_and_localities(spark):
    page = '<title>Flats at Hill Road | X</title><nav><a>Projects in <b>Sea</b> Side</a></nav><p>2 BHK 1,200 sq.ft. ₹1.2 Cr, 3 BHK of 1500 sqft ₹ 95 Lakh; 4 BHK soon</p>'
    df = spark.createDataFrame([(1, page), (2, page.replace("<nav>", "<div>")), (3, '<meta name="description" content="Homes in Lake View, Pune">' + page), (4, None)], "page_id long, html string")
    got = sorted(tuple(r) for r in pages.configurations(df.where("page_id = 1")).collect())
    assert got == [(1, 1, 2, 1200.0, 12_000_000.0), (1, 2, 3, 1500.0, 9_500_000.0)]
    assert {r[0]: (r[1], r[2]) for r in pages.localities(df).collect()} == {1: ("Sea Side", "trail"), 2: ("Hill Road", "title"), 3: ("Lake View", "description"), 4: (None, None)}
