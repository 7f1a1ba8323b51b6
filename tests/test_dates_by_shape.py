"""Dates are read once and only from texts of their form."""

from pyspark.sql import functions as F

from loanloom.functions.columns import dated
from loanloom.operators import compliance, documents, validators
from loanloom.plans import validations

SF = "/root/testdata/sf0.001"
TEXTS = ("1/2/1985", "01/02/1985", "31/02/1985", "1-2-1985", "1985-2-1", "1985-02-30", "1.2.1985", "1 Feb 1985", "1 february 1985", "1 Febr 1985", "12/3/85", "12/3/985", "+1/2/1985", "1/2/+12345", "01985-2-1", "19850-2-1", "May 2024", "MAY 2024", "Mayy 2024",
         "June 2024", "Jun 2024", "Sept 2024", "7/2024", "007/2024", "7-2024", "2024-7", "2024/7", "13/2024", "-7/2024", "1985", "unknown", "", " ", " 1/2/1985", "1/2/1985\n", "1/2/1985 ", "१/2/1985", None)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shape_rules_no_date_out(spark):
    forms = sorted({*validators.BORN, *compliance.DATE_FORMATS, "MMMM yyyy", "MMM yyyy", "M/yyyy", "M-yyyy", "yyyy-M", "yyyy/M"})
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for form in forms:
        found = rows.select("t", dated(F.col("t"), form).cast("string").alias("ours"), F.try_to_date("t", form).cast("string").alias("theirs")).collect()
        assert [r["ours"] for r in found] == [r["theirs"] for r in found], form
        assert any(r["ours"] is not None for r in found), form


def test_dates_are_read_once(spark):
    assert optimized(validations.v_validation(spark, SF)).count("gettimestamp") <= 6 + 6  # each format of a month once, of a birth date once and short years three times
    slips = spark.createDataFrame([("Mayy 2024",)], "m string")
    assert slips.select(documents.month(F.col("m")).alias("m")).first()["m"] is None
