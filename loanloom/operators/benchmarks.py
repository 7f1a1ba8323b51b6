"""Matchers and rules against labelled examples, and the whole evaluation of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.columns import rounded
from loanloom.operators import monitoring

THRESHOLDS = (60, 70, 75, 80, 85, 90, 95, 100)


def _ratio(a: Column, b: Column) -> Column:
    return rounded(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)


def matcher(pairs: DataFrame, score: str, same: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Confusion, precision, recall and F1 of a score (0 to 100) against whether two names are the same, at each
    threshold: one aggregation."""
    s, y = F.col(score), F.col(same)
    kinds = {"tp": lambda t: (s >= t) & y, "fp": lambda t: (s >= t) & ~y, "fn": lambda t: (s < t) & y, "tn": lambda t: (s < t) & ~y}
    one = pairs.agg(*[F.count_if(f(t)).alias(f"{n}{t}") for t in thresholds for n, f in kinds.items()])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{t}").alias(n) for n in kinds]) for t in thresholds])
    c = F.col
    return one.select(F.inline(rows)).select("threshold", *kinds, _ratio(c("tp"), c("tp") + c("fp")).alias("precision"), _ratio(c("tp"), c("tp") + c("fn")).alias("recall"), _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))


def flags(cases: DataFrame) -> DataFrame:
    """Of each flag code in expected or produced (arrays): found, missed and wrongly raised, precision and recall."""
    codes = cases.select("expected", "produced", F.explode(F.array_union("expected", "produced")).alias("code"))
    due, said = F.array_contains("expected", F.col("code")), F.array_contains("produced", F.col("code"))
    found = codes.groupBy("code").agg(F.count_if(due & said).alias("tp"), F.count_if(due & ~said).alias("fn"), F.count_if(~due & said).alias("fp"))
    c = F.col
    return found.select("code", "tp", "fn", "fp", _ratio(c("tp"), c("tp") + c("fp")).alias("precision"), _ratio(c("tp"), c("tp") + c("fn")).alias("recall"))


def evaluation(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """The evaluation report as tidy rows (metric, value): class averages, ranking of denials by low scores, Brier
    score and calibration error, from one table of cases (actual, predicted, confidence, right, risk_score)."""
    summary = monitoring.class_summary(cases, labels)
    ranking = monitoring.discrimination(cases.withColumn("denied", F.when(F.col("actual") == "DENY", 1).otherwise(0)), "risk_score", "denied").select("auc", "gini", "ks")
    out = None
    for df in (summary, ranking, monitoring.brier(cases, "confidence", "right").select("brier"), monitoring.calibration_error(cases, "confidence", "right")):
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in df.columns])))
        out = rows if out is None else out.unionByName(rows)
    return out


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """A report as tidy rows (section, metric, value) of one-row tables of numbers; each stays one aggregation."""
    out = None
    for section, df in sections.items():
        metrics = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in df.columns])
        rows = df.select(F.lit(section).alias("section"), F.inline(metrics))
        out = rows if out is None else out.unionByName(rows)
    return out
