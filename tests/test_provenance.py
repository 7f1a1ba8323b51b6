"""Extracted fields and where they come from, on texts read by hand."""

import pytest

from loanloom.operators import documents, provenance

TEXTS = {
    1: ("PAN_CARD", "INCOME TAX DEPARTMENT\nGOVT. OF INDIA\n ASHA RAO \n12/03/1985\nABCPR1234F"),
    2: ("PAN_CARD", "ABCCR1234F\nName: Asha Rao\nFather's Name: Ram Dev\nDOB 2-4-1979"),
    3: ("AADHAAR_CARD", "Government of India\nAsha Rao\nDOB: 01/02/1985\nFEMALE\nXXXX XXXX 1234\nFlat 4, MG Road, Pune 411001"),
    4: ("AADHAAR_CARD", "Name: Asha Rao\nYear of Birth: 1985\nMALE\n2345 6789 1234\nAddress:\n12 Lake Side\nErode 638001"),
    5: ("BANK_STATEMENT", "Village Bank\nName: Asha Rao\nA/C No. 123456789\nIFSC SBIN0123456\n01/02 ECS BOUNCE 5.00\nNACH RETURN COUNT: 0\nCHEQUE RETURN 7.00"),
    6: ("BANK_STATEMENT", "statement of SBI\nName: Axis Branch\nInward ECS Returns: 3\nSALARY CREDIT\nref 0.00 77.50\n61,000.00"),
    7: ("PROPERTY_DEED", "Possession Letter\nIn favour of\nAsha Rao\nBuilder: Acme & Sons\nProperty Address:\n12 Lake Road,\nWhitefield, Pune, 560066\nSuper Built-up Area: 1,450.5 Sq. Ft.\nSale Consideration Rs. 45,00,000"),
    8: ("SALARY_SLIP", "Payslip\nAcme Works\nEmployee Name: Asha Rao\nGross Salary: Rs. 1,00,000\nTotal Deductions 10,000\nNet Pay: 90,000.00\nMonth: June 2026"),
    9: ("FORM_16", "TAN of the deductor: ABCD12345E\nPAN of the employee: ABCPR1234F\nAssessment Year: 2024 - 25\nGross Salary u/s 17: 12,00,000"),
    10: ("ITR", None),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, k, t) for i, (k, t) in TEXTS.items()], "application_id long, doc_class string, text string")
    out = {}
    for r in provenance.provenance(docs).collect():
        out[r["application_id"], r["field"]] = (r["value"], r["snippet"], r["start"], r["confidence"])
    return out


@pytest.mark.parametrize("at,want", [
    ((1, "full_name"), ("ASHA RAO", "ASHA RAO", "ASHA RAO", 0.80)),
    ((1, "dob"), ("12/03/1985", "12/03/1985", "12/03/1985", 0.95)),
    ((2, "full_name"), ("Asha Rao", "Name: Asha Rao\nFather", "Name: Asha Rao\nFather", 0.92)),
    ((2, "father_name"), ("Ram Dev", "Father's Name: Ram Dev\nDOB", "Father's Name: Ram Dev\nDOB", 0.92)),
    ((2, "dob"), ("2-4-1979", "DOB 2-4-1979", "DOB 2-4-1979", 0.95)),
    ((3, "full_name"), ("Asha Rao", "Asha Rao", "Asha Rao", 0.82)),
    ((3, "gender"), ("Female", "Female", "FEMALE", 0.98)),
    ((3, "aadhaar_number"), ("XXXX-XXXX-1234", "XXXX XXXX 1234", "XXXX XXXX 1234", 0.96)),
    ((3, "address"), ("Flat 4, MG Road, Pune 411001", "Flat 4, MG Road, Pune 411001", "Flat 4, MG Road, Pune 411001", 0.80)),
    ((4, "address"), ("12 Lake Side Erode 638001", "Address:\n12 Lake Side\nErode 638001", "Address:\n12 Lake Side\nErode 638001", 0.88)),
    ((4, "dob"), ("1985", "Year of Birth: 1985", "Year of Birth: 1985", 0.94)),
    ((5, "account_holder"), ("Asha Rao", "Asha Rao", "Asha Rao", 0.90)),
    ((5, "bank_name"), ("Scheduled Commercial Bank", "Scheduled Commercial Bank", None, 0.95)),
    ((6, "bank_name"), ("SBI", "SBI", "SBI", 0.95)),
    ((7, "buyer"), ("Asha Rao", "Asha Rao", "In favour of", 0.90)),
    ((7, "property_address"), ("12 Lake Road,\nWhitefield, Pune, 560066", "12 Lake Road,\nWhitefield, Pune, 560066", "Property Address:", 0.95)),
    ((7, "locality"), ("Whitefield", "Whitefield", "Whitefield", 0.85)),
    ((7, "super_area"), ("1450.5", "1450.5 Sq. Ft.", None, 0.92)),
    ((7, "value"), ("4,500,000.00", "Consideration: ₹4,500,000.00", "Sale Consideration", 0.94)),
    ((8, "employer_name"), ("Acme Works", "Acme Works", "Acme Works", 0.90)),
    ((8, "gross_salary"), ("100,000.00", "Gross Salary: ₹100,000.00", "Gross Salary", 0.95)),
    ((9, "assessment_year"), ("2024-25", "Assessment Year: 2024 - 25", "Assessment Year: 2024 - 25", 0.96)),
])
def test_by_hand(found, at, want):
    got = found[at]
    assert (got[0], got[1], got[3]) == (want[0], want[1], want[3])
    at_start = TEXTS[at[0]][1][got[2] - 1 :] if got[2] else None
    assert (at_start is None) if want[2] is None else at_start.startswith(want[2])


def test_what_is_not_found(found):
    assert (6, "account_holder") not in found  # a bank's name is no holder
    assert not [k for k in found if k[0] == 10]  # a null text has no fields


def test_validity_and_bounces(spark):
    docs = spark.createDataFrame([(i, k, t) for i, (k, t) in TEXTS.items()], "application_id long, doc_class string, text string")
    of = lambda kind, *c: {r[0]: tuple(r[1:]) for r in provenance.extracted(docs.where(f"doc_class = '{kind}'"), kind).select("application_id", *c).collect()}
    assert of("BANK_STATEMENT", "bounce_count", "is_valid") == {5: (2, False), 6: (3, False)}
    assert of("AADHAAR_CARD", "is_masked", "is_valid") == {3: (True, True), 4: (False, True)}
    assert of("PAN_CARD", "entity_type", "is_valid") == {1: ("Individual", True), 2: ("Company", True)}
    assert of("FORM_16", "is_valid") == {9: (True,)}


def test_look_ahead_passes_over_a_leading_zero(spark):
    docs = spark.createDataFrame([(6, TEXTS[6][1])], "application_id long, text string")
    assert [tuple(r) for r in documents.transactions(docs).collect()] == [(6, 3, "SALARY", 61000.0)]
