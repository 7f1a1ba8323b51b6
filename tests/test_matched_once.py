"""A pattern of a bank stands in the plan for its place alone, not for each column that reads it."""

from loanloom.operators import provenance


def test_statement_patterns_are_matched_once(spark):
    rows = spark.createDataFrame([("1", "Statement of sbi\nA/C No. 1234567890\n05/02/2024 PAYROLL 0.00\nref\n\n61,000.00")], "application_id string, text string")
    df = provenance.extracted(rows, "BANK_STATEMENT")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?i)\bBank of Baroda\b") <= 2  # whether it is there, and where
    row = df.first()
    assert (row["bank_name"], row["account_number"], row["bounce_count"]) == ("SBI", "1234567890", 0)
    assert [(p["field"], p["value"], p["start"]) for p in row["provenance"] if p["field"] == "bank_name"] == [("bank_name", "SBI", 14)]
