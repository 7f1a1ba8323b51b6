"""Scores of candidates without what is alike anyway, and pairs of places spread over tasks."""

import random

from pyspark.sql import functions as F

from loanloom.functions.columns import rounded
from loanloom.operators import matching, reports

rnd = random.Random(8)


def test_thousandths_are_those_of_decimals(spark):
    values = [rnd.random() for _ in range(20000)] + [k / 2000 for k in range(2001)] + [k / 2000 + d for k in range(2001) for d in (-1e-7, -6e-11, -4e-11, 4e-11, 6e-11, 1e-7) if k]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", matching._thousandths(F.col("x")).alias("ours"), rounded(F.col("x"), 3).alias("theirs"))
    assert rows.where("ours <> theirs or ours is null").count() == 0


def test_candidates_have_the_whole_score(spark):
    pick = rnd.choice
    fields = "listing_id long, city string, locality string, bedrooms int, area_sqft double, price_inr double"
    side = lambda base: spark.createDataFrame([(base + k, pick(["x", "y", None]), pick(["Hill", "hill.", "Lake View", None]), pick([1, 2, None]), pick([600.0, 640.0, 0.0, None]), pick([5e6, 5.2e6, None])) for k in range(60)], fields)
    a, b = side(0), side(100)
    named = lambda df, p: df.withColumn("plain", matching.plain(F.col("locality"))).select(*[F.col(n).alias(f"{p}{n}") for n in ("listing_id", *matching._COMPARED)])
    both = named(a, "a_").join(named(b, "b_"), F.col("a_city") == F.col("b_city"))
    all_ = both.select("a_listing_id", "b_listing_id", matching.match_score("a_", "b_").alias("score")).where("score >= 0.6")
    assert sorted(map(tuple, matching.candidates(a, b).collect())) == sorted(map(tuple, all_.collect()))


def test_joins_of_many_rows_are_spread(spark):
    """Adaptive execution leaves a given number of partitions as it is: the exchanges below the join have one."""
    subjects = spark.createDataFrame([(1, "x", "h", 2), (2, "x", None, 2)], "application_id long, city string, locality string, bhk int")
    listings = spark.createDataFrame([(7, "x", "h", 2, "Sale"), (8, "x", "h", 2, "Rent"), (9, "x", "h", 2, "Sale")], "listing_id long, city string, locality string, bedrooms int, transaction_type string")
    found = reports.exact_place(subjects, listings)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 9)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
