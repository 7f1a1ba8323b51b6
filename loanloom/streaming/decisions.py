"""Decision metrics over the audit log, in tumbling windows; the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(log: DataFrame, threshold: float = 0.85, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts of each window of ts. On a stream, rows later than `late` are dropped and a window is
    appended once it is complete; on a table the watermark has no effect."""
    found = log.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("decision") == "APPROVE").alias("n_approve"),
        F.count_if(F.col("decision") == "DENY").alias("n_deny"),
        F.count_if(F.col("decision") == "SUSPEND").alias("n_suspend"),
        F.count_if(F.col("confidence") < threshold).alias("n_below_threshold"),
    )
    return found.select(F.col("window.start").alias("window_start"), "n", "n_approve", "n_deny", "n_suspend", "n_below_threshold")
