"""Quality of document ingestion: classes, costs, fields and texts against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.columns import rounded
from loanloom.functions.names import edit_distance
from loanloom.operators.texts import same_field, word_f1

#: The cost of taking a document of the first class for the second; OTHER for classes not named.
CLASS_COSTS = {
    "BANK_STATEMENT": {"BANK_STATEMENT": 0, "SALARY_SLIP": 10, "FORM_16": 6, "ITR": 6, "PAN_CARD": 8, "AADHAAR_CARD": 8, "PROPERTY_DEED": 8, "UNKNOWN": 2, "OTHER": 8},
    "PAN_CARD": {"PAN_CARD": 0, "AADHAAR_CARD": 4, "SALARY_SLIP": 8, "FORM_16": 6, "ITR": 6, "BANK_STATEMENT": 8, "PROPERTY_DEED": 8, "UNKNOWN": 2, "OTHER": 8},
    "AADHAAR_CARD": {"AADHAAR_CARD": 0, "PAN_CARD": 4, "SALARY_SLIP": 8, "FORM_16": 6, "ITR": 6, "BANK_STATEMENT": 8, "PROPERTY_DEED": 8, "UNKNOWN": 2, "OTHER": 8},
    "SALARY_SLIP": {"SALARY_SLIP": 0, "FORM_16": 3, "ITR": 3, "BANK_STATEMENT": 10, "PAN_CARD": 8, "AADHAAR_CARD": 8, "PROPERTY_DEED": 8, "UNKNOWN": 2, "OTHER": 6},
    "FORM_16": {"FORM_16": 0, "ITR": 2, "SALARY_SLIP": 3, "BANK_STATEMENT": 8, "PAN_CARD": 6, "AADHAAR_CARD": 6, "PROPERTY_DEED": 8, "UNKNOWN": 2, "OTHER": 6},
    "ITR": {"ITR": 0, "FORM_16": 2, "SALARY_SLIP": 3, "BANK_STATEMENT": 8, "PAN_CARD": 6, "AADHAAR_CARD": 6, "PROPERTY_DEED": 8, "UNKNOWN": 2, "OTHER": 6},
    "PROPERTY_DEED": {"PROPERTY_DEED": 0, "BANK_STATEMENT": 8, "SALARY_SLIP": 8, "FORM_16": 8, "ITR": 8, "PAN_CARD": 8, "AADHAAR_CARD": 8, "UNKNOWN": 3, "OTHER": 8},
    "UNKNOWN": {"UNKNOWN": 0, "OTHER": 3},
}
#: The cost of any mistake about a class that the table lacks.
OTHER_COST = 5.0


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _counts(cases: DataFrame, labels: tuple[str, ...], count: str | None) -> DataFrame:
    a, p, n = F.col("actual"), F.col("predicted"), F.col(count) if count else F.lit(1)
    times = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("long")
    return cases.agg(times(F.lit(True)).alias("n"), times(a == p).alias("right"), *[x for k, v in enumerate(labels) for x in (times(a == v).alias(f"s{k}"), times(p == v).alias(f"c{k}"), times((a == v) & (p == v)).alias(f"h{k}"))])


def _scores(k: int) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of the kth label; F1 from the rounded two."""
    p, q = rounded(_ratio(F.col(f"h{k}"), F.col(f"c{k}")), 4), rounded(_ratio(F.col(f"h{k}"), F.col(f"s{k}")), 4)
    return p, q, rounded(_ratio(2 * p * q, p + q), 4)


def class_report(cases: DataFrame, labels: tuple[str, ...], count: str | None = None) -> DataFrame:
    """Support, precision, recall and F1 of each class, with four places."""
    rows = F.array(*[F.struct(F.lit(v).alias("label"), F.col(f"s{k}").alias("support"), *[x.alias(n) for x, n in zip(_scores(k), ("precision", "recall", "f1"), strict=True)]) for k, v in enumerate(labels)])
    return _counts(cases, labels, count).select(F.inline(rows))


def class_summary(cases: DataFrame, labels: tuple[str, ...], count: str | None = None) -> DataFrame:
    """count: the column that says how often a row of cases occurs (once). Accuracy, macro averages over all labels, and balanced accuracy over those that occur, all from rounded values."""
    mean = lambda i: rounded(sum((_scores(k)[i] for k in range(len(labels))), F.lit(0.0)) / len(labels), 4)
    occurs = sum((F.when(F.col(f"s{k}") > 0, 1).otherwise(0) for k in range(len(labels))), F.lit(0))
    recalls = sum((F.when(F.col(f"s{k}") > 0, _scores(k)[1]).otherwise(0.0) for k in range(len(labels))), F.lit(0.0))
    return _counts(cases, labels, count).select("n", rounded(_ratio(F.col("right"), F.col("n")), 4).alias("accuracy"), rounded(_ratio(recalls, occurs), 4).alias("balanced_accuracy"), mean(0).alias("macro_precision"), mean(1).alias("macro_recall"), mean(2).alias("macro_f1"))


def class_cost(cases: DataFrame, count: str | None = None) -> DataFrame:
    """The mean cost of the calls: of classes the table lacks 5 for a mistake."""
    a, p = F.col("actual"), F.col("predicted")
    cost = F.when(a == p, 0.0).otherwise(OTHER_COST)
    for actual, row in CLASS_COSTS.items():
        own = F.lit(float(row.get("OTHER", OTHER_COST)))
        for predicted, value in row.items():
            own = F.when(p == predicted, float(value)).otherwise(own)
        cost = F.when(a == actual, own).otherwise(cost)
    n = F.col(count) if count else F.lit(1)
    whole = F.coalesce(F.sum(n), F.lit(0)).cast("long")
    return cases.agg(whole.alias("n"), rounded(F.try_divide(F.sum(cost * n), whole), 4).alias("cost_weighted_error"))


def numeric_match(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """1 where two number texts differ by tolerance at most, else 0 (also where one is no number)."""
    return F.when(F.abs(a.try_cast("double") - b.try_cast("double")) <= tolerance, 1.0).otherwise(0.0)


def field_quality(rows: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    """Of rows (field, truth, found): exact match and word F1 of each field, and for numeric fields the share within 1."""
    number = F.when(F.col("field").isin(*numeric), numeric_match(F.col("truth"), F.col("found")))
    return rows.groupBy("field").agg(F.count("*").alias("n"), rounded(F.avg(same_field(F.col("truth"), F.col("found")).cast("int")), 4).alias("exact_match"), rounded(F.avg(word_f1(F.col("truth"), F.col("found"))), 4).alias("token_f1"), rounded(F.avg(number), 4).alias("numeric_match"))


def text_errors(rows: DataFrame, reference: str, predicted: str, group: str) -> DataFrame:
    """Character and word error rates, 1 at most, averaged by group; an empty reference counts 0 or 1."""
    a, b = F.coalesce(reference, F.lit("")), F.coalesce(predicted, F.lit(""))
    words = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    cer = F.when(a == "", F.when(b == "", 0.0).otherwise(1.0)).otherwise(rounded(F.least(F.lit(1.0), F.levenshtein(a, b) / F.char_length(a)), 4))
    wer = F.when(F.size(words(a)) == 0, F.when(F.size(words(b)) == 0, 0.0).otherwise(1.0)).otherwise(rounded(F.least(F.lit(1.0), edit_distance(words(a), words(b)) / F.size(words(a))), 4))
    return rows.groupBy(group).agg(F.count("*").alias("n"), rounded(F.avg(cer), 4).alias("cer"), rounded(F.avg(wer), 4).alias("wer"))
