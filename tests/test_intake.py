"""Appends and streams."""

from loanloom.sources import listing_table
from loanloom.streaming import decisions

SCHEMA = "listing_id long, source_url string"


def test_append_twice(spark, tmp_path):
    path = str(tmp_path / "listings")
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], SCHEMA)
    listing_table.append(batch, path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 3, 4, 5]
    listing_table.append(spark.createDataFrame([(6, "a"), (7, "c"), (8, None)], SCHEMA), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 3, 4, 5, 7, 8]
    assert listing_table.new_rows(batch.limit(0), batch).count() == 0


def test_windows_of_a_stream(spark, tmp_path):
    log = spark.createDataFrame(
        [("2024-01-01 10:00:00", "APPROVE", 0.9), ("2024-01-01 23:00:00", "SUSPEND", 0.5), ("2024-01-02 08:00:00", "DENY", None), ("2024-01-05 00:00:00", None, 0.9)],
        "ts string, decision string, confidence double",
    )
    log = log.withColumn("ts", log["ts"].cast("timestamp"))
    source = str(tmp_path / "log")
    log.write.parquet(source)
    stream = decisions.windowed(spark.readStream.schema(log.schema).parquet(source))
    query = stream.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r)[1:] for r in spark.table("windows").collect())
    assert got == [(1, 0, 1, 0, 0), (2, 1, 0, 1, 1)]  # the last window is still open
    assert decisions.windowed(log).count() == 3


def test_new_by_key(spark):
    schema = "listing_id long, city string, locality string, bedrooms int, area_sqft double"
    held = spark.createDataFrame([(1, "x", None, 2, 800.0), (2, "y", "l", 1, 500.0)], schema)
    batch = spark.createDataFrame([(3, "x", None, 2, 800.0), (5, "y", "l", 2, 500.0), (4, "y", "l", 2, 500.0), (6, None, None, None, None), (7, None, None, None, None)], schema)
    found = listing_table.new_by_key(batch, held)
    assert found.columns == batch.columns
    assert sorted(r["listing_id"] for r in found.collect()) == [4, 6]
    assert listing_table.new_by_key(batch.limit(0), held).count() == 0
