"""Profiles read each document once, and the methods that Spark makes of the patterns are short enough to be compiled."""

import re

from loanloom.operators import documents, profiles
from loanloom.plans import documents as plans

SF = "/root/testdata/sf0.001"
ROWS = "application_id string, filename string, text string"


def longest_method(df):
    """Bytes of the longest method generated for df; the JVM compiles none of 8,000 or more."""
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    found = [re.search(r"ByteCodeStats\((\d+)", parts.apply(k)._3().toString()) for k in range(parts.size())]
    return max(int(m[1]) for m in found if m)


def test_classification_is_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([("1", "a.pdf", "PAN")], ROWS)
        for columns in (("doc_class",), ("doc_class", "class_confidence")):
            assert longest_method(documents.classified(docs).select("application_id", *columns)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_words_without_their_shared_part():
    words = [w for ws in documents.WORDS.values() for w in ws]
    assert all(sum(p in w for w in words) >= 1 for p in documents.SHARED)


def test_class_ties_and_none(spark):
    docs = spark.createDataFrame([("1", "pan_aadhaar.pdf", None), ("2", None, None), ("3", "x.pdf", "Vid"), ("4", None, "help@UIDAI.gov.in female")], ROWS)
    got = {r["application_id"]: (r["doc_class"], r["class_confidence"]) for r in documents.classified(docs).collect()}
    # 4: uidai 3, help@uidai.gov.in 2, male 0.5, female 0.5, the pattern of UIDAI 2.5
    assert got == {"1": ("PAN_CARD", 0.6), "2": ("UNKNOWN", 0.3), "3": ("UNKNOWN", 0.3), "4": ("AADHAAR_CARD", 0.84)}


def test_profiles_deal_documents_out_once(spark):
    for query in (plans.d13_profiles, plans.k10_compliance_input):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "RDD" not in plan and "LeftOuter" not in plan
        assert plan.count("RepartitionByExpression") == 1


def test_profile_of_several_documents(spark):
    docs = spark.createDataFrame([
        ("1", "b.pdf", "Permanent Account Number\nABCPK1234F\nName: Asha Rao\n", "PAN_CARD"), ("1", "a.pdf", "ABCPZ9999Z\nName: Old Name\n", "PAN_CARD"),
        ("1", "s1.pdf", "Employee Name: Asha R\nGross Salary: 100\nNet Pay: 80", "SALARY_SLIP"), ("1", "s2.pdf", None, "SALARY_SLIP"),
        ("1", "d.pdf", "in PUNE, once of mumbai\nProperty Address: 1 Lake Road, Pune", "PROPERTY_DEED"), ("1", "u.pdf", "2345 6789 1234\nAddress: Flat 7, Lake Road", "AADHAAR_CARD"),
        ("2", "f.pdf", "Gross Salary: 1200", "FORM_16"), ("2", "k.pdf", "A/C No. 123456789", "BANK_STATEMENT"), ("3", "n.txt", "a letter", "UNKNOWN"),
    ], ROWS + ", doc_class string")
    one, two, three = profiles.profiles(docs).orderBy("application_id").collect()
    assert (one["primary_name"], one["pan_number"], one["aadhaar_number"], one["property_city"]) == ("Asha Rao", "ABCPK1234F", "2345-6789-1234", "Mumbai")
    assert (one["monthly_gross"], one["monthly_net"], one["n_slips"], one["n_missing"], one["verification_status"]) == (50.0, 40.0, 2, 1, "partial")
    assert (two["monthly_gross"], two["n_slips"], two["n_missing"], two["source_of_funds_declared"], two["flags"]) == (100.0, 0, 3, True, "missing_documents,incomplete_kyc")
    assert (three["primary_name"], three["n_missing"], three["source_of_funds_declared"]) == ("Applicant", 5, False)
