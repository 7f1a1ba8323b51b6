"""Stored tables that are changed in place: upserts by key, children replaced with their parents, full replacement,
numbered batches and baselines of score bands.

A keyed table is partitioned by a hash of its key. A change reads and rewrites only the partitions that its keys fall in;
Spark moves a partition's new files into place when the whole write has succeeded, so a batch that fails leaves the table as it
was, and one that is run again gives the same table. At most PARTS partition numbers come to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.sources.listing_table import new_rows

PARTS = 256


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _numbers(df: DataFrame) -> list[int]:
    return [r["part"] for r in df.select("part").distinct().collect()]


def _write(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.parquet(path).drop("part")


def upsert(batch: DataFrame, path: str, key: str = "application_id", order: str = "saved_at", parts: int = PARTS) -> None:
    """Saves batch: of each key the newest row (by order) of table and batch is kept. Rows without a key are left out. The
    number of parts must stay what it was when the table was made."""
    spark = batch.sparkSession
    new = batch.where(F.col(key).isNotNull()).withColumn("part", _part(key, parts))
    if exists(spark, path):
        new = spark.read.parquet(path).where(F.col("part").isin(_numbers(new))).select(*new.columns).unionByName(new)
    newest = new.groupBy("part", key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r"))
    _write(newest.select(key, "r.*", "part"), path, "part")


def replace_children(children: DataFrame, parents: DataFrame, path: str, key: str = "application_id", parts: int = PARTS) -> None:
    """Replaces all children that the table has of the keys of parents by those given; children of other keys stay.
    A parent without children loses those it had."""
    spark = children.sparkSession
    keys = parents.where(F.col(key).isNotNull()).select(key).distinct().withColumn("part", _part(key, parts))
    new = children.join(keys, key).select(*children.columns, "part")
    touched = _numbers(keys)
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("part").isin(touched)).select(*new.columns)
        new = old.join(keys.select(key), key, "left_anti").select(*new.columns).unionByName(new)
    _write(new, path, "part")
    left = set(_numbers(spark.read.parquet(path).where(F.col("part").isin(touched)).join(keys.select(key), key, "left_anti"))) | set(_numbers(children.join(keys, key)))
    files, folder = _folder(spark, path)
    for part in set(touched) - left:  # a partition that no row is left for isn't overwritten
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"part={part}"), True)


def replace_table(rows: DataFrame, path: str) -> int:
    """Replaces the whole table by rows once they are all written beside it, and gives their number. A failing write
    leaves the table as it was."""
    spark = rows.sparkSession
    fresh, gone = f"{path}.new", f"{path}.old"
    rows.write.mode("overwrite").parquet(fresh)
    n = spark.read.parquet(fresh).count()
    files, folder = _folder(spark, path)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files.delete(at(gone), True)
    if files.exists(folder):
        files.rename(folder, at(gone))
    files.rename(at(fresh), folder)
    files.delete(at(gone), True)
    return n


def append_batch(batch: DataFrame, path: str, number: int, key: str = "source_url") -> None:
    """Appends the new rows of a numbered batch (see new_rows) as a partition of its own. A batch that is run again under
    its number meets the keys of the other batches alone and replaces what it wrote, rows without a key included."""
    spark = batch.sparkSession
    there = spark.read.parquet(path).where(F.col("batch") != number) if exists(spark, path) else batch.limit(0)
    _write(new_rows(batch, there, key).withColumn("batch", F.lit(number).cast("long")), path, "batch")


def save_bands(records: DataFrame, score: str, edges: tuple[float, ...], path: str, version: int) -> None:
    """Stores the number of scores in each band of descending edges (0: the highest) as a version of a baseline; batches
    of one period are merged by summing versions. Saving a version again replaces it."""
    band = sum((F.when(F.col(score) < e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = records.where(F.col(score).isNotNull()).groupBy(band.cast("int").alias("band")).agg(F.count("*").alias("n"))
    _write(counts.withColumn("version", F.lit(version).cast("long")), path, "version")


def stability_against(records: DataFrame, score: str, edges: tuple[float, ...], path: str, versions: tuple[int, ...]) -> DataFrame:
    """PSI of the records' scores against the stored bands of the given versions: psi, n_baseline, n_current and status. As in
    monitoring.stability_index, empty shares are raised to 1e-4 and either side without rows gives null."""
    from loanloom.functions.columns import rounded

    spark = records.sparkSession
    band = sum((F.when(F.col(score) < e, 1).otherwise(0) for e in edges), F.lit(0))
    held = spark.read.parquet(path).where(F.col("version").isin(*versions))
    base = held.agg(*[F.coalesce(F.sum(F.when(F.col("band") == k, F.col("n"))), F.lit(0)).alias(f"b{k}") for k in range(len(edges) + 1)])
    now = records.where(F.col(score).isNotNull()).agg(*[F.count_if(band == k).alias(f"c{k}") for k in range(len(edges) + 1)])
    bands = range(len(edges) + 1)
    total = {s: sum((F.col(f"{s}{k}") for k in bands), F.lit(0)) for s in "bc"}
    share = lambda s, k: F.when(F.col(f"{s}{k}") > 0, F.try_divide(F.col(f"{s}{k}"), total[s])).otherwise(1e-4)
    psi = sum(((share("c", k) - share("b", k)) * F.ln(share("c", k) / share("b", k)) for k in bands), F.lit(0.0))
    # two rows of one each: aggregates of a whole table
    out = base.crossJoin(now).select(F.when((total["b"] > 0) & (total["c"] > 0), rounded(psi, 4)).alias("psi"), total["b"].alias("n_baseline"), total["c"].alias("n_current"))
    return out.withColumn("status", F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") <= 0.25, "moderate shift").when(F.col("psi").isNotNull(), "significant shift"))
