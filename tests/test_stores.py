"""Tables that are changed in place: round trips, failures and repeats."""

import pytest
from pyspark.sql import functions as F

from loanloom.operators import monitoring
from loanloom.sources import stores

ROW = "application_id long, saved_at long, decision string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_keeps_the_newest_and_survives_failures(spark, tmp_path):
    path = str(tmp_path / "applications")
    of = lambda *x: spark.createDataFrame(list(x), ROW)
    stores.upsert(of((1, 10, "A"), (2, 10, "B"), (1, 12, "C"), (None, 1, "D")), path, parts=4)
    stores.upsert(of((2, 9, "old"), (3, 1, "E")), path, parts=4)
    want = [(1, 12, "C"), (2, 10, "B"), (3, 1, "E")]
    read = lambda: rows(stores.stored(spark, path).select("application_id", "saved_at", "decision"))
    assert read() == want
    broken = of((1, 99, "X"), (3, 99, "Y")).withColumn("decision", F.when(F.col("application_id") == 3, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("decision")))
    with pytest.raises(Exception, match="stop"):
        stores.upsert(broken, path, parts=4)
    assert read() == want
    stores.upsert(of((1, 99, "X")), path, parts=4)
    stores.upsert(of((1, 99, "X")), path, parts=4)
    assert read() == [(1, 99, "X"), (2, 10, "B"), (3, 1, "E")]


def test_children_go_with_their_parents(spark, tmp_path):
    path = str(tmp_path / "items")
    child = lambda *x: spark.createDataFrame(list(x), "application_id long, item string")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "application_id long")
    stores.replace_children(child((1, "a"), (1, "b"), (2, "c"), (3, "d")), keys(1, 2, 3), path, parts=3)
    stores.replace_children(child((1, "e")), keys(1, 2), path, parts=3)
    assert rows(stores.stored(spark, path).select("application_id", "item")) == [(1, "e"), (3, "d")]
    stores.replace_children(child().limit(0), keys(3), path, parts=3)
    assert rows(stores.stored(spark, path).select("application_id", "item")) == [(1, "e")]


def test_full_replacement(spark, tmp_path):
    path = str(tmp_path / "listings")
    assert stores.replace_table(spark.range(5), path) == 5
    with pytest.raises(Exception, match="stop"):
        stores.replace_table(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    assert stores.replace_table(spark.range(2), path) == 2 and spark.read.parquet(path).count() == 2


def test_a_batch_run_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "appended")
    of = lambda *x: spark.createDataFrame(list(x), "listing_id long, source_url string")
    first, second = of((1, "u"), (2, None), (3, "u"), (4, "v")), of((5, "v"), (6, None), (7, "w"))
    for _ in range(2):
        stores.append_batch(first, path, 0)
    for _ in range(2):
        stores.append_batch(second, path, 1)
    assert rows(spark.read.parquet(path).select("listing_id", "source_url").where("source_url is not null")) == [(1, "u"), (4, "v"), (7, "w")]
    assert rows(spark.read.parquet(path).where("source_url is null").select("listing_id")) == [(2,), (6,)]


def test_drift_against_stored_bands(spark, tmp_path):
    path, edges = str(tmp_path / "bands"), (80.0, 60.0, 40.0)
    old = spark.range(900).select((F.col("id") % 97).cast("double").alias("s"))
    new = spark.range(500).select((F.col("id") % 71 + 20).cast("double").alias("s"))
    stores.save_bands(old.limit(400), "s", edges, path, 1)
    stores.save_bands(old.limit(400), "s", edges, path, 1)
    stores.save_bands(old.where("s >= 0").subtract(old.limit(0)).limit(0), "s", edges, path, 3)
    stores.save_bands(old, "s", edges, path, 2)
    got = stores.stability_against(new, "s", edges, path, (2,)).first()
    both = old.withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))
    want = monitoring.stability_index(both, "s", F.col("base"), edges).first()
    assert (got["psi"], got["n_baseline"], got["n_current"], got["status"]) == (want["psi"], 900, 500, want["status"])
    assert stores.stability_against(new, "s", edges, path, (1, 2)).first()["n_baseline"] == 1300


def test_rank_metrics_over_many_distinct_scores(spark):
    """Prefix sums by ranges give the figures of one walk, and no window of the plan lacks a partition."""
    df = spark.range(30_000).select(F.col("id"), (F.xxhash64("id") % 1_000_003).cast("double").alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("bad"))
    found = monitoring.discrimination(df, "s", "bad")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_part" in x for x in plan.splitlines() if "Window" in x)
    data = sorted((r["s"], r["bad"]) for r in df.collect())
    goods, bads = sum(1 - b for _, b in data), sum(b for _, b in data)
    wins, g, b, ks, k = 0.0, 0, 0, 0.0, 0
    while k < len(data):
        end = k
        while end < len(data) and data[end][0] == data[k][0]:
            end += 1
        dg, db = sum(1 - x for _, x in data[k:end]), sum(x for _, x in data[k:end])
        wins += dg * b + dg * db / 2
        g, b, k = g + dg, b + db, end
        ks = max(ks, abs(b / bads - g / goods))
    r = found.first()
    assert (r["n_good"], r["n_bad"]) == (goods, bads)
    assert r["auc"] == pytest.approx(wins / goods / bads, abs=1e-6) and r["ks"] == pytest.approx(ks, abs=1e-6)
