"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that can be reached) of all ids in edges (a, b). Each round points the larger
    neighbours of a node at the smallest one it knows, then the smaller ones too; a chain of n nodes takes some log(n)
    rounds. Ids must not be null; an edge of a node with itself makes it a component."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = cut(small.distinct())
        # done once every node points at one other node alone, which points at nothing but itself
        bad = small.where("u <> v").groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        inner = small.where("u <> v").select(F.col("v").alias("u")).distinct().join(bad.select("u"), "u", "left_semi")
        if bad.where("n > 1").isEmpty() and inner.isEmpty():
            return small.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        now = small
