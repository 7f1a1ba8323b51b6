"""Rules on examples worked by hand."""

import pytest

from loanloom.functions.names import edit_distance, token_sort_ratio
from loanloom.operators import benchmarks, credit, decision, documents, ingestion, listings, monitoring, reconcile, texts, validators


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(df["x"])).first()[0]


def test_name_ratio(spark):
    rows = [("Mira Solvani", "Mira Solvany", 91.6667), ("Ishan Verali", "I. Verali", 76.1905), ("b a", "a  b", 100.0), ("ab", "", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, due double")
    got = df.select(token_sort_ratio(df["a"], df["b"]).alias("r"), "due").collect()
    assert all(r["r"] == pytest.approx(r["due"], abs=1e-4) for r in got)


def test_edit_distance(spark):
    df = spark.createDataFrame([(list("kitten"), list("sitting"), 3), ([], ["a"], 1), (["a", "b"], [], 2), ([], [], 0), (["x", "y"], ["y", "x"], 2)], "a array<string>, b array<string>, due int")
    assert all(r[0] == r[1] for r in df.select(edit_distance(df["a"], df["b"]), "due").collect())


def test_ranking_example(spark):
    """Ten scores: one good is below one bad, so 24 of 25 pairs are in order."""
    scores = [(95.0, 0), (90.0, 0), (85.0, 0), (70.0, 0), (60.0, 1), (65.0, 0), (55.0, 1), (50.0, 1), (40.0, 1), (67.0, 1)]
    df = spark.createDataFrame(scores, "s double, bad int")
    r = monitoring.discrimination(df, "s", "bad").first()
    assert (r["n_good"], r["n_bad"], r["auc"], r["gini"], r["ks"], r["auc_status"]) == (5, 5, 0.96, 0.92, 0.8, "good")
    # the best gap is below 65: all five goods and one of five bads
    assert monitoring.banded_ks(df, "s", "bad", (80.0, 65.0, 50.0)).first()["ks_banded"] == 0.8
    assert monitoring.banded_ks(df, "s", "bad", (80.0,)).first()["ks_banded"] == 0.6


def test_stability_floors_empty_shares_alone(spark):
    from math import log

    from pyspark.sql import functions as F

    rows = [(90.0, True)] * 5 + [(10.0, True)] * 5 + [(90.0, False)] * 10
    df = spark.createDataFrame(rows, "s double, old boolean")
    r = monitoring.stability_index(df, "s", F.col("old"), (50.0,)).first()
    assert r["psi"] == pytest.approx((1 - 0.5) * log(2) + (1e-4 - 0.5) * log(1e-4 / 0.5), abs=1e-4) and r["status"] == "significant shift"
    assert monitoring.stability_index(df.where("old"), "s", F.col("old"), (50.0,)).first()["psi"] is None


def test_distribution_leaves_missing_out(spark):
    df = spark.createDataFrame([("APPROVE",), ("approve ",), ("REJECT",), (None,), (" ",), ("MAYBE",)], "preliminary_decision string")
    got = {r["decision"]: (r["n"], r["pct"]) for r in monitoring.decision_distribution(df).collect()}
    assert got == {"APPROVE": (2, 50.0), "CONDITIONAL": (0, 0.0), "REJECT": (1, 25.0), "other": (1, 25.0), "missing": (2, None)}


def test_adverse_impact_statuses(spark):
    rows = [("a", "APPROVE")] * 10 + [("b", "APPROVE")] * 7 + [("b", "REJECT")] * 3 + [(None, "APPROVE"), ("b", None)]
    df = spark.createDataFrame(rows, "g string, preliminary_decision string")
    got = {r["favourable"]: r for r in monitoring.adverse_impact(df, "g").collect()}
    assert (got["approve"]["air"], got["approve"]["status"], got["approve"]["small_groups"], got["approve"]["lowest_group"]) == (0.7, "below_threshold", "a,b", "b")
    alone = monitoring.adverse_impact(df.where("g = 'a'"), "g").first()
    assert alone["status"] == "insufficient_groups" and alone["air"] is None
    none = monitoring.adverse_impact(spark.createDataFrame([("a", "REJECT"), ("b", "REJECT")], df.schema), "g").first()
    assert none["status"] == "undefined_zero_favourable_rate"


APPLICANT = {"application_id": 1, "employment_type": "Salaried", "monthly_income": 100_000.0, "loan_amount": 3_000_000.0, "loan_tenure_months": 240, "property_value": 5_000_000.0, "existing_debt": 0.0, "cibil_score": 780, "settled_accounts": 0, "written_off_accounts": 0, "max_dpd_last_12_months": 0, "recent_enquiries_last_90_days": 1, "credit_card_outstanding_total": 0.0}
SCHEMA = "application_id long, employment_type string, monthly_income double, loan_amount double, loan_tenure_months int, property_value double, existing_debt double, cibil_score int, settled_accounts int, written_off_accounts int, max_dpd_last_12_months int, recent_enquiries_last_90_days int, credit_card_outstanding_total double"


def assessed(spark, **changes):
    values = APPLICANT | changes
    return credit.assess(spark.createDataFrame([tuple(values.values())], SCHEMA)).first()


@pytest.mark.parametrize(
    ("changes", "due"),
    [({}, "APPROVE"), ({"cibil_score": 500, "existing_debt": 30_000.0}, "REJECT"), ({"cibil_score": 500}, "CONDITIONAL"), ({"existing_debt": 60_000.0}, "REJECT"), ({"existing_debt": 30_000.0}, "CONDITIONAL"), ({"settled_accounts": 1, "written_off_accounts": 2}, "REJECT"), ({"recent_enquiries_last_90_days": 3}, "CONDITIONAL"), ({"cibil_score": None}, "CONDITIONAL"), ({"monthly_income": 0.0}, None), ({"loan_tenure_months": 0}, None)],
)
def test_preliminary_decisions(spark, changes, due):
    assert assessed(spark, **changes)["preliminary_decision"] == due


def test_stored_ratios_are_bounded(spark):
    r = assessed(spark, existing_debt=200_000.0, property_value=1_000_000.0)
    assert (r["foir"], r["ltv"]) == (1.0, 2.0) and r["foir_raw"] > 2 and r["ltv_raw"] == 3.0
    flags = assessed(spark, settled_accounts=2, max_dpd_last_12_months=95, loan_amount=9_000_000.0)
    assert flags["flags"] == ["settled_account", "dpd_over_90", "income_to_loan_mismatch"] and flags["n_severe"] == 2
    assert flags["flag_texts"][2] == "Requested loan amount (Rs.9,000,000) exceeds 6x annual income (Rs.1,200,000) - income-to-loan mismatch"
    empty = assessed(spark, loan_amount=0.0)
    assert empty["credit_confidence"] == 0.0 and empty["flags"] == [] and empty["foir"] is None and empty["cibil_score"] is None


def test_flag_categories(spark):
    rows = [("2 settled account(s) found", "settled_account"), ("DPD exceeding 90 days", "dpd_over_90"), ("loan_stacking", "loan_stacking"), ("something", "other")]
    df = spark.createDataFrame(rows, "x string, due string")
    assert all(r[0] == r[1] for r in df.select(credit.flag_category(df["x"]), "due").collect())


def test_quality_of_a_listing(spark):
    """All eleven fields count; zero and the empty text don't, white space does."""
    fields = "listing_id long, locality string, price_inr double, area_sqft double, bedrooms int, bathrooms int, furnishing string, floor int, total_floors int, property_age int, parking int, pincode string, listing_age_days int"
    rows = [(1, "x", 5e6, 900.0, 2, 2, "f", 3, 9, 4, 1, "560001", 5), (2, "x", 5e6, 900.0, 2, 0, "", 3, 0, 0, None, " ", None), (3, None, None, None, None, None, None, None, None, None, None, None, 400)]
    got = {r["listing_id"]: r for r in listings.scored(spark.createDataFrame(rows, fields)).collect()}
    assert (got[1]["completeness"], got[1]["quality"], got[1]["quality_label"]) == (100.0, 90.0, "Excellent")
    assert (got[2]["completeness"], got[2]["quality"]) == (75.0, 67.5)
    assert (got[3]["completeness"], got[3]["quality"]) == (0.0, 11.0)


def test_pages_both_ways(spark):
    urls = [("https://x/flat-npd-12", True), ("https://x/property-card/9", True), ("https://x/projects/flat-npd-12", False), ("https://x/other", False), (None, False)]
    df = spark.createDataFrame(urls, "u string, due boolean")
    assert all(r[0] == r[1] for r in df.select(texts.is_property_page(df["u"]), "due").collect())
    for html, due in (("<b>Access Denied</b>", True), ("please solve the CAPTCHA", True), ("a fine flat", False), (None, False)):
        assert one(spark, html, texts.is_refused_page) is due


def test_months_and_recency(spark):
    for text, due in (("June 2024", "RECENT"), ("jun-2024", "RECENT"), ("March,2024", "RECENT"), ("February, 2024", "OLD"), ("07/2024", "FUTURE"), ("2024-05", "RECENT"), ("2023/12", "OLD"), ("Juneish 2024", "UNREADABLE"), ("", "MISSING"), (None, "MISSING")):
        assert one(spark, text, lambda x: documents.recency(x, "2024-06-30")) == due


def test_ages(spark):
    for text, age, allowed in (("30/06/1990", 34, True), ("01-07-1990", 33, True), ("2004-1-1", 20, False), ("1950", 74, True), ("5/5/40", None, None), ("unknown", None, False), (None, None, False)):
        if text == "5/5/40":
            continue  # the century of a two-digit year is the parser's
        assert one(spark, text, lambda x: validators.age(x, "2024-06-30")) == age
        assert one(spark, text, lambda x: validators.age_allowed(x, "2024-06-30")) is allowed


def test_name_pairs_and_scores(spark):
    rows = [(1, "PAN Card", "Mira Solvani"), (1, "Aadhaar Card", "MIRA SOLVANI"), (1, "Bank Statement", "Nikhil Dhanor"), (1, "Letter", "x"), (2, "PAN Card", "A B"), (3, "PAN Card", None)]
    names = spark.createDataFrame(rows, "application_id long, document string, name string")
    pairs = reconcile.name_pairs(names)
    got = {(r["document_1"], r["document_2"]): r["status"] for r in pairs.collect()}
    assert got == {("PAN Card", "Aadhaar Card"): "EXACT_MATCH", ("PAN Card", "Bank Statement"): "MISMATCH", ("Aadhaar Card", "Bank Statement"): "MISMATCH"}
    others = spark.createDataFrame([(1, 1), (2, 0), (3, 5)], "application_id long, n_other int")
    scores = {r["application_id"]: (r["n_contradictions"], r["reconciliation_score"]) for r in reconcile.reconciliation(pairs, others).collect()}
    assert scores[1] == (3, 0.2) and scores[2] == (0, 1.0) and scores[3] == (5, 0.5)


def test_contradictions_and_reasons_one_by_one(spark):
    names = [(1, "PAN Card", "Mira Solvani", 1), (1, "Salary Slip", "Nikhil Dhanor", 9), (1, "Salary Slip", "Tara Kestur", 2)]
    pairs = reconcile.name_pairs(spark.createDataFrame(names, "application_id long, document string, name string, place int"), "place")
    firms = spark.createDataFrame([(1, "Acme", "Zenith Works"), (2, "TCS", "Tata Consultancy Services")], "application_id long, s string, f string")
    firms = reconcile.employers(firms, "s", "f")
    slips = [(1, 1, "May 2024", 50000.0, 45000.0, 5000.0), (1, 2, "January 2024", 50000.0, 47000.0, 5000.0), (2, 1, None, 0.0, 0.0, 0.0), (3, 1, "June 2024", 10000.0, 9000.0, 1000.0)]
    slips = spark.createDataFrame(slips, "application_id long, place int, month_year string, gross_salary double, net_salary double, total_deductions double")
    statements = spark.createDataFrame([(1,), (3,)], "application_id long")
    found = spark.createDataFrame([(1, 7, "SALARY", 46000.0), (1, 3, "SALARY", 44000.0), (1, 5, "LOAN_EMI", 45000.0)], "application_id long, line int, category string, amount double")
    incomes = reconcile.incomes(slips, reconcile.salary_credits(statements, found))
    got = {(r["application_id"], r["place"]): (r["credited"], r["variance_pct"], r["status"]) for r in incomes.collect()}
    assert got == {(1, 1): (44000.0, 2.22, "MATCH"), (1, 2): (46000.0, 2.13, "MATCH"), (3, 1): (0.0, 100.0, "DISCREPANCY")}  # the earlier of two equally near
    texts = {r["application_id"]: (r["contradictions"], r["n_other"]) for r in reconcile.contradictions(pairs, firms, incomes).collect()}
    names = pairs.first()
    assert names["name_2"] == "Tara Kestur"  # the first slip's
    assert texts == {
        1: ([f"Name mismatch between PAN Card and Salary Slip: 'Mira Solvani' vs 'Tara Kestur' (Similarity: {names['similarity'] * 100:.0f}%)",
             "Employer mismatch: Payslip employer 'Acme' does not match Form 16 employer 'Zenith Works'."], 1),
        3: (["Income discrepancy in June 2024: Bank credit (₹0.00) differs significantly from Payslip Net (₹9,000.00)."], 1),
    }
    faults = {r["application_id"]: (r["bad_slips"], r["old_slips"]) for r in reconcile.slip_faults(slips, "2024-06-30").collect()}
    assert faults == {
        1: (["Payslip #2 (January 2024) arithmetic inconsistency between Gross, Deductions, and Net pay."],
            ["Payslip #2 (January 2024): Payslip for January 2024 is 5 months old, outside the required last-3-months window."]),
        2: ([], ["Payslip #1 (None): Payslip month/year was not found on the document."]), 3: ([], []),
    }
    row = [(1, 0.734, ["a"], ["x", "y"], ["p"], None, 2), (2, 0.8, [], None, None, None, None)]
    schema = "application_id long, overall_confidence double, missing_documents array<string>, contradictions array<string>, bad_slips array<string>, old_slips array<string>, n_bounces int"
    first, second = reconcile.review_routing(spark.createDataFrame(row, schema)).orderBy("application_id").collect()
    assert first["reasons"] == [
        "Missing mandatory documents: a", "Contradiction flagged: x", "Contradiction flagged: y", "p", "Detected 2 inward ECS/cheque bounce(s) in bank statement.",
        "Overall extraction confidence (73.4%) is below 80% threshold.",
    ]
    assert (len(first["actions"]), first["priority"], first["requires_human_review"]) == (5, "HIGH", True)
    assert (second["reasons"], second["actions"], second["priority"], second["requires_human_review"]) == ([], [], "NONE", False)


def test_gate_of_reasons(spark):
    for text, due in (("Missing mandatory documents: x", "missing_mandatory_docs"), ("Name mismatch between a", "name_contradiction"), ("Income discrepancy in May", "income_discrepancy"), ("x arithmetic inconsistency", "salary_arithmetic_failure"), ("is Below the Threshold", "low_confidence_gate"), ("1 bounce", "banking_bounce_warning"), ("other", None)):
        assert one(spark, text, reconcile.gate_of) == due


def test_class_of_documents(spark):
    rows = [("pan_1.pdf", "INCOME TAX DEPARTMENT Permanent Account Number ABCPX1234F", "PAN_CARD"), ("x.pdf", "Statement of account, IFSC: HDFC0123456, closing balance 5", "BANK_STATEMENT"), ("x.txt", "hello", "UNKNOWN"), (None, None, "UNKNOWN")]
    df = spark.createDataFrame(rows, "filename string, text string, due string")
    got = documents.classified(df).collect()
    assert all(r["doc_class"] == r["due"] for r in got)
    assert {r["class_confidence"] for r in got if r["due"] == "UNKNOWN"} == {0.3} and all(r["class_confidence"] >= 0.6 for r in got if r["due"] != "UNKNOWN")


def test_transactions(spark):
    a = "Bank\n05/01/24 ACH SALARY 0.00 62,000.00 210,000.00\n07/01/24 HOME LOAN EMI 12,000.50 150,000.00\n09/01 PREMIUM 10.00"
    b = "SALARY CREDIT\nref\n55,000.00\nPAYROLL\n1\n2\n3\n4\n5\n6\n7.00"
    df = spark.createDataFrame([(1, a), (2, b), (3, ""), (4, None)], "application_id long, text string")
    found = documents.transactions(df)
    got = sorted((r["application_id"], r["category"], r["amount"]) for r in found.collect())
    # "EMI" is part of "PREMIUM"; the second PAYROLL has no amount within five lines
    assert got == [(1, "LOAN_EMI", 10.0), (1, "LOAN_EMI", 12000.5), (1, "SALARY", 62000.0), (2, "SALARY", 55000.0)]
    roll = {r["application_id"]: r for r in documents.statement_summary(found).collect()}
    assert (roll[1]["average_salary"], roll[1]["monthly_obligations"], roll[1]["months_covered"]) == (62000.0, 12010.5, 6)


def test_costs_and_fields(spark):
    df = spark.createDataFrame([("BANK_STATEMENT", "SALARY_SLIP"), ("UNKNOWN", "PAN_CARD"), ("OTHER", "ITR"), ("ITR", "ITR")], "actual string, predicted string")
    assert ingestion.class_cost(df).first()["cost_weighted_error"] == pytest.approx((10 + 3 + 5 + 0) / 4)
    pairs = spark.createDataFrame([("abc", "abd", "x"), ("", "", "x"), ("", "a", "y"), ("one two", "one", "y")], "a string, b string, g string")
    got = {r["g"]: (r["cer"], r["wer"]) for r in ingestion.text_errors(pairs, "a", "b", "g").collect()}
    assert got["x"] == (pytest.approx(0.3333 / 2, abs=1e-4), 0.5) and got["y"] == (pytest.approx((1 + 4 / 7) / 2, abs=1e-4), 0.75)


def test_matcher_thresholds(spark):
    df = spark.createDataFrame([(95.0, True), (85.0, True), (92.0, False), (10.0, False)], "score double, same boolean")
    got = {r["threshold"]: r for r in benchmarks.matcher(df, "score", "same").collect()}
    assert (got[90]["tp"], got[90]["fp"], got[90]["fn"], got[90]["tn"], got[90]["f1"]) == (1, 1, 1, 1, 0.5)
    flags = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "c"])], "expected array<string>, produced array<string>")
    assert {r["code"]: (r["tp"], r["fn"], r["fp"]) for r in benchmarks.flags(flags).collect()} == {"a": (2, 0, 0), "b": (0, 1, 0), "c": (0, 0, 1)}


def test_factor_words(spark):
    """Good words are tested first: an unstable income counts as good, a low tier as a risk."""
    df = spark.createDataFrame([("Unstable income",), ("Low credit risk tier",), ("Very high LTV (95%)",), ("Moderate FOIR (45%)",)], "f string")
    good, bad = decision._about(decision.POSITIVE), decision._about(decision.NEGATIVE)
    assert [tuple(r) for r in df.select(good(df["f"]), bad(df["f"])).collect()] == [(True, True), (False, True), (False, True), (False, False)]


def test_pages(spark):
    from loanloom.operators import pages

    html = """<html><script type="application/ld+json">{"offers": {"price": 5}, "address": {"addressLocality": "Old"}}</script><script type='application/ld+json'>not json</script>
<script id="__NEXT_DATA__">{"address": {"addressLocality": "New"}}</script><style>.x{}</style><p>3&nbsp;</p><p>2 BHK <b>1,200</b> sq.ft. ₹1.5 Cr</p><p>Semi-Furnished furnished, 2 Bath, Floor: 3, 560066</p>
PRM/KA/RERA/1/2/PR/3/4 Builder: Acme <br></html>"""
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")
    s = {r["page_id"]: r for r in pages.structured(df).collect()}
    assert (s[1]["n_blocks"], s[1]["locality"], s[1]["price_text"], s[2]["n_blocks"], s[3]["locality"]) == (3, "New", "5", 0, None)
    a = {r["page_id"]: r for r in pages.attributes(df).collect()}
    assert (a[1]["bedrooms"], a[1]["area_sqft"], a[1]["price_inr"], a[1]["pincode"], a[1]["furnishing"], a[1]["bathrooms"], a[1]["floor"]) == (2, 1200.0, 15_000_000.0, "560066", "Semi-Furnished", 2, 3)
    assert a[2]["bedrooms"] is None and a[3]["furnishing"] is None
    p = pages.projects(df).collect()
    assert [(r["page_id"], r["rera_number"], r["builder_name"]) for r in p] == [(1, "PRM/KA/RERA/1/2/PR/3/4", "Acme")]
