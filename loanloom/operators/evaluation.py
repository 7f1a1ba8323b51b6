"""Whole reports as tidy rows (section, metric, value). The narrow columns that a report needs are computed once and
cut from their lineage; every section is an aggregation of that table, so its source is scanned and assessed once.

Defined results: a section without rows gives the metrics of an empty aggregation (null, or 0 where it counts); labels
beyond the given ones count in n and in the cost alone; values are doubles, a truth is 1 or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.lineage import cut
from loanloom.operators import monitoring


def tidy(df: DataFrame, section: str, *names: str, key: Column | None = None) -> DataFrame:
    """The named columns of each row as rows of a report; with a key, metrics are called key.name."""
    called = lambda n: F.lit(n) if key is None else F.concat(F.coalesce(key.cast("string"), F.lit("none")), F.lit("." + n))
    rows = F.array(*[F.struct(called(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(section).alias("section"), F.inline(rows))


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


SUMMARY = ("n", "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1", "cost_weighted_error")
CLASS = ("support", "precision", "recall", "f1")
RANKING = ("n_good", "n_bad", "auc", "gini", "ks")
BIN = ("n", "mean_confidence", "accuracy")
RUNTIME = ("n", "n_approve", "n_deny", "n_suspend", "suspend_rate", "auto_rate", "mean_confidence", "below_threshold_rate", "agreement_rate")


def decisions(cases: DataFrame, audit: DataFrame, labels: tuple[str, ...], denied: str = "DENY") -> DataFrame:
    """The evaluation of decisions: classes, confusions, denials ranked by low scores, stated confidence and its bins,
    and the audit log's runtime figures and gates. cases: actual, predicted, confidence, right, risk_score."""
    rows = cut(cases.select("actual", "predicted", "confidence", "right", "risk_score", (F.col("actual") == denied).cast("int").alias("denied")))
    log = cut(audit.select("decision", "confidence", "underwriter_rec", "analyst_rec", "gate_triggered"))
    pair = F.concat_ws(">", "actual", "predicted")
    return united([
        tidy(monitoring.class_summary(rows, labels), "summary", *SUMMARY),
        tidy(monitoring.class_report(rows, labels), "class", *CLASS, key=F.col("label")),
        tidy(monitoring.confusion(rows, labels), "confusion", "n", key=pair),
        tidy(monitoring.discrimination(rows, "risk_score", "denied"), "ranking", *RANKING),
        tidy(monitoring.brier(rows, "confidence", "right"), "confidence", "brier"),
        tidy(monitoring.calibration_error(rows, "confidence", "right"), "confidence", "ece"),
        tidy(monitoring.reliability(rows, "confidence", "right"), "reliability", *BIN, key=F.col("bin")),
        tidy(monitoring.runtime_metrics(log), "runtime", *RUNTIME),
        tidy(monitoring.gate_counts(log), "gate", "n", key=F.col("gate")),
    ])


OUTCOME = ("available", "n_labelled", "n_bad", "auc", "gini", "ks", "ks_banded")
GROUP = ("place", "n", "bad", "bad_rate_pct", "violates")
BUCKET = ("n", "mean_confidence", "realised_correct", "gap", "well_calibrated")


def outcomes(records: DataFrame, bands: tuple[str, ...], tiers: tuple[str, ...], edges: tuple[float, ...]) -> DataFrame:
    """Scores against outcomes: ranking, bad rates by credit band and by tier with breaks of their order, and
    confidence against what came true. records: assessed applications, outcome_bad 0, 1 or null."""
    rows = cut(records.select("risk_score", "credit_band", "risk_tier", "preliminary_decision", "credit_confidence", "outcome_bad"))
    return united([
        tidy(monitoring.outcome_report(rows, "risk_score", "outcome_bad", edges), "outcome", *OUTCOME),
        tidy(monitoring.bad_rate_by_group(rows, "credit_band", bands), "band", *GROUP, key=F.col("group_name")),
        tidy(monitoring.bad_rate_by_group(rows, "risk_tier", tiers), "tier", *GROUP, key=F.col("group_name")),
        tidy(monitoring.calibration(rows), "calibration", *BUCKET, key=F.col("bucket")),
    ])


FLOOR = ("n", "at_floor", "at_floor_pct", "floor_alert", "formula_mismatches")
UPSTREAM = ("reviewed", "not_reviewed", "overridden", "rate_pct")
AGREEMENT = ("compared", "skipped", "agreement_rate_pct")


def portfolio(records: DataFrame, group: str, overrides: str, final: str) -> DataFrame:
    """The first-phase report: bureau sources, flags, decisions, confidence, agreement of credit and final
    decisions, corrections by reviewers and adverse impact of a group. final: the column of final decisions."""
    rows = cut(records.select("application_id", "bureau_source", "flags", "n_flags", "cibil_score", "preliminary_decision", "credit_confidence", group, overrides, final))
    pair = F.concat_ws(">", "preliminary_decision", final)
    return united([
        tidy(monitoring.source_mix(rows), "source", "n", "pct", key=F.col("source")),
        tidy(monitoring.flag_rates(rows), "flag", "n", "pct", key=F.col("flag")),
        tidy(monitoring.decision_distribution(rows), "decision", "n", "pct", key=F.col("decision")),
        tidy(monitoring.confidence_summary(rows), "floor", *FLOOR),
        tidy(monitoring.confidence_bins(rows), "bin", "n", "pct", key=F.col("bin")),
        tidy(monitoring.agreement(rows, "preliminary_decision", final), "agreement", "n", key=pair),
        tidy(monitoring.agreement_rate(rows, "preliminary_decision", final), "agreement", *AGREEMENT),
        tidy(monitoring.upstream_quality(rows, overrides), "upstream", *UPSTREAM),
        tidy(monitoring.upstream_fields(rows, overrides), "upstream_field", "n", key=F.col("field")),
        tidy(monitoring.adverse_impact(rows, group), "impact", "air", "flagged", key=F.col("favourable")),
    ])
