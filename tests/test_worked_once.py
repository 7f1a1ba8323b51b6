"""Costly steps stand once in the plan of a query, however many columns or sections read them."""

from pyspark.sql import functions as F

from loanloom.operators import documents, ingestion, reconcile
from loanloom.operators.texts import name_similarity
from loanloom.plans import resolution

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_cleaned_once(spark):
    rows = spark.createDataFrame([("Asha Rao", "ASHA R")], "a string, b string")
    assert optimized(rows.select(name_similarity(F.col("a"), F.col("b")).alias("s"))).count("regexp_replace") <= 4


def test_patterns_are_matched_once(spark):
    slips = spark.createDataFrame([("1", "Gross Salary: 5")], "application_id string, text string")
    plan = optimized(documents.fields(slips, "SALARY_SLIP"))
    assert plan.count("(?i)(?:House\\s*Rent") == 1
    row = documents.fields(slips, "SALARY_SLIP").first()
    assert (row["gross_salary"], row["net_salary"], row["earnings"], row["adds_up"]) == (5.0, 0.0, [], False)


def test_routing_compares_documents_once(spark):
    assert optimized(resolution.a56_review_routing(spark, SF)).count("explode(flatten") == 1


def test_compared_documents(spark):
    pairs = spark.createDataFrame([("1", "PAN Card", "A", "Aadhaar Card", "B", 0.5, "MISMATCH"), ("1", "PAN Card", "A", "Salary Slip", "A", 1.0, "EXACT_MATCH"), ("2", "PAN Card", "C", "Salary Slip", "C", 1.0, "EXACT_MATCH")],
                                  "application_id string, document_1 string, name_1 string, document_2 string, name_2 string, similarity double, status string")
    firms = spark.createDataFrame([("1", "X", "Y", 0.1, "MISMATCH"), ("3", "X", "X", 1.0, "MATCH")], "application_id string, slip_employer string, form_employer string, similarity double, status string")
    incomes = spark.createDataFrame([], "application_id string, place int, month_year string, net_salary double, credited double, status string")
    found = {r["application_id"]: r for r in reconcile.compared(pairs, firms, incomes).collect()}
    assert [len(found[k]["contradictions"]) for k in "123"] == [2, 0, 0]
    assert (found["1"]["n_names"], found["1"]["n_other"], found["1"]["mean"]) == (1, 1, 0.75)
    assert (found["3"]["n_other"], found["3"]["mean"]) == (0, None)
    assert [r["application_id"] for r in reconcile.contradictions(pairs, firms, incomes).collect()] == ["1"]


def test_counted_classes(spark):
    rows = spark.createDataFrame([("PAN_CARD", "PAN_CARD", 3), ("PAN_CARD", "ITR", 1)], "actual string, predicted string, n long")
    assert ingestion.class_summary(rows, ("PAN_CARD", "ITR"), "n").first()["accuracy"] == 0.75
    assert ingestion.class_cost(rows, "n").first()["cost_weighted_error"] == 1.5


def test_needed_parts_rule_no_match_out(spark):
    """A pattern is looked for wherever it matches: each of its parts is in the lower case of what it matches."""
    said = ["PERMANENT\n ACCOUNT number", "uidai", "Unique  Identification", "FORM no. 16", "tan: abcd12345e", "itr-v", "Acknowledgment Number", "IFSC HDFC0123456", "account no", "Statement Period", "net pay", "Gross Salary", "hra", "Basic pay", "provident fund", "agreement for sale", "allotment letter", "sale deed", "Schedule 'A'"]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    for pattern, parts in documents.NEEDS.items():
        held = documents._holds(F.lower("t"), parts)
        assert rows.where(F.col("t").rlike(pattern)).count() > 0
        assert rows.where(F.col("t").rlike(pattern) & ~held).count() == 0
    assert set(documents.NEEDS) == {p for ps in documents.ANCHORS.values() for p in ps if p.startswith("(?i)")}
