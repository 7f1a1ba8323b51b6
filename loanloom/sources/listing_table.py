"""Idempotent appends to a listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, existing: DataFrame, key: str = "source_url", order: str = "listing_id") -> DataFrame:
    """Rows of batch to append: the first of each key (by order) that existing lacks. A null key is
    never a duplicate, so such rows skip the window and the join."""
    keyed = batch.where(F.col(key).isNotNull())
    first = F.row_number().over(W.partitionBy(key).orderBy(order))
    fresh = keyed.withColumn("_nth", first).where("_nth = 1").drop("_nth")
    fresh = fresh.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.where(F.col(key).isNull()))


def new_by_key(batch: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("city", "locality", "bedrooms", "area_sqft"), order: str = "listing_id") -> DataFrame:
    """Rows of batch to append: the first of each combination of keys that existing lacks. Nulls are equal
    to each other here. Map-side aggregation keeps a frequent combination from filling one task."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
    held = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.join(held, same, "left_anti")


def append(batch: DataFrame, path: str) -> None:
    """Appends the new rows of batch to the Parquet table at path, made on first use."""
    spark = batch.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    existing = spark.read.schema(batch.schema).parquet(path) if there else batch.limit(0)
    new_rows(batch, existing).write.mode("append").parquet(path)
