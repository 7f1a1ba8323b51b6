"""Queries of field checks, appends and the audit log, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import oracle, view
from loanloom.operators import validators
from loanloom.sources import listing_table
from loanloom.streaming import decisions


def j14_latest_decision(spark, sf_dir):
    return validators.latest_decision(view(spark, sf_dir, "applications"), view(spark, sf_dir, "audit_log"))


def s09_new_listings(spark, sf_dir):
    """Listings of two sources appended to those of the others."""
    raw = view(spark, sf_dir, "raw_listings")
    batch = F.col("source") != "square_yards"
    return listing_table.new_rows(raw.where(batch), raw.where(~batch)).select("listing_id", "source", "source_url")


def x01_decision_windows(spark, sf_dir):
    found = decisions.windowed(view(spark, sf_dir, "audit_log"))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


QUERIES = {f.__name__: f for f in (j14_latest_decision, s09_new_listings, x01_decision_windows)}

ORACLE = {
    "j14_latest_decision": oracle(
        """SELECT a.application_id, l.latest_decision, coalesce(l.n_audited, 0) AS n_audited FROM applications a
LEFT JOIN (SELECT application_id, arg_max(decision, seq) AS latest_decision, count(*) AS n_audited FROM audit_log GROUP BY 1) l ON l.application_id = a.application_id""",
        "applications",
        "audit_log",
    ),
    "s09_new_listings": oracle(
        """SELECT listing_id, source, source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY listing_id) AS nth FROM raw_listings WHERE source <> 'square_yards')
WHERE source_url IS NULL OR (nth = 1 AND source_url NOT IN (SELECT source_url FROM raw_listings WHERE source = 'square_yards' AND source_url IS NOT NULL))""",
        "raw_listings",
    ),
    "x01_decision_windows": oracle(
        """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, count(*) FILTER (WHERE decision = 'APPROVE') AS n_approve,
 count(*) FILTER (WHERE decision = 'DENY') AS n_deny, count(*) FILTER (WHERE decision = 'SUSPEND') AS n_suspend, count(*) FILTER (WHERE confidence < 0.85) AS n_below_threshold
FROM audit_log GROUP BY 1""",
        "audit_log",
    ),
}
