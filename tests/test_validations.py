"""Results of the field checks by hand."""

from loanloom.operators import validators

COLUMNS = "application_id long, pan_number string, surname string, aadhaar_number string, ifsc_code string, gross_salary double, net_salary double, total_deductions double, earnings_sum double, month_year string, assessment_year string, financial_year string, dob string"


def test_messages(spark):
    rows = [
        (1, " abcpr1234f ", "rao", "2345 6789 1234", "sbin0123456", 1000.0, 900.0, 100.0, 1000.0, "May 2024", "2024-25", "2023-24", "01/07/1990"),
        (2, "ABCCX1234F", None, "XXXX-XXXX-1234", "SBIN1123456", 1000.0, 950.0, 100.0, None, "07/2024", "2024-25", "2022-23", "1990"),
        (3, None, None, "0234 5678 9012", "", 0.0, 10.0, 0.0, None, "soon", None, "2023-24", "1-2-2010"),
        (4, "ABCPR1234F", "Das", "XX12", None, 123456.5, 123456.5, 0.0, 100.0, "Jan 2024", "2024", "2023", "5/6/55"),
        (5, "X", "", None, None, None, None, None, None, None, None, None, "someday"),
    ]
    found = {}
    for r in validators.validations(spark.createDataFrame(rows, COLUMNS), "2024-06-30").collect():
        found[r["application_id"], r["field"]] = (r["is_valid"], r["severity"], r["message"])
    assert len(found) == 35
    assert found[1, "pan_number"] == (True, "INFO", "Valid PAN: ABCPR1234F (Individual)")
    assert found[1, "age"] == (True, "INFO", "Applicant age is 33 years (within eligible 21-65 range).")
    assert found[1, "salary_math"] == (True, "INFO", "Salary arithmetic perfectly reconciled (Gross = Net + Deductions).")
    assert found[2, "pan_number"][:2] == (True, "WARNING") and "entity type is 'C'" in found[2, "pan_number"][2]
    assert found[2, "aadhaar_number"][:2] == (True, "INFO") and found[2, "ifsc_code"][:2] == (False, "ERROR")
    assert found[2, "salary_math"] == (False, "ERROR", "Payslip arithmetic mismatch: Gross (₹1,000.00) - Deductions (₹100.00) = ₹900.00, but Net Pay is ₹950.00 (Variance: ₹50.00)")
    assert found[2, "payslip_recency"] == (False, "WARNING", "Payslip for 07/2024 is dated in the future relative to today (2024-06-30).")
    assert found[2, "assessment_year"] == (False, "ERROR", "Assessment Year '2024-25' is inconsistent with Financial Year '2022-23' (Expected AY 2023-24).")
    assert found[2, "dob"] == (True, "INFO", "Calculated age from YOB: 34 years.")
    assert found[3, "aadhaar_number"][2] == "Aadhaar number cannot start with 0 or 1." and found[3, "salary_math"][2] == "Gross or Net Salary is zero/missing."
    assert found[3, "payslip_recency"][2] == "Could not parse payslip date: 'soon'." and found[3, "age"][:2] == (False, "ERROR")
    assert found[4, "pan_number"] == (True, "WARNING", "PAN 5th character 'R' does not match applicant surname initial 'D'.")
    assert found[4, "salary_math"][:2] == (True, "WARNING") and "5 months old" in found[4, "payslip_recency"][2]
    assert found[4, "aadhaar_number"][2] == "Invalid masked Aadhaar format."
    assert found[5, "dob"] == (False, "WARNING", "Could not parse DOB format: 'someday'.")
    rates = {r["field"]: (r["n"], r["n_failed"]) for r in validators.failure_rates(validators.validations(spark.createDataFrame(rows, COLUMNS), "2024-06-30")).collect()}
    assert rates["pan_number"] == (5, 2) and rates["aadhaar_number"] == (5, 3) and rates["dob"] == (2, 1)
