"""The long table of all field checks and the failure rates of fields, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.operators import documents as x
from loanloom.operators import validators
from loanloom.plans.documents import _G, _N, _T, AS_OF, _columns, _parts, slips, texts
from loanloom.plans.sql import r
from loanloom.plans.texts import NUMBERS, numbers


@once
def checked_fields(s, d):
    """What the checks need of each application, from its form, its payslip and its form 16."""
    c = F.col
    form = view(s, d, "case_inputs").select("application_id", F.col("pan_text").alias("pan_number"), F.element_at(F.split("name", " "), -1).alias("surname"), F.col("dob_text").alias("dob"))
    codes = numbers(s, d).select("application_id", F.col("national_number").alias("aadhaar_number"), F.col("branch_code").alias("ifsc_code"))
    earned = F.aggregate("earnings", F.lit(0.0), lambda a, e: a + e["amount"])
    slip = slips(s, d).select("application_id", "gross_salary", "net_salary", "total_deductions", earned.alias("earnings_sum"), "month_year")
    tax = x.fields(texts(s, d, "FORM_16"), "FORM_16").select("application_id", "assessment_year", "financial_year")
    df = form.join(codes, "application_id").join(slip, "application_id", "left").join(tax, "application_id", "left")
    return df.withColumn("earnings_sum", F.when(c("earnings_sum") > 0, c("earnings_sum")))


def v_validation(s, d):
    return validators.validations(checked_fields(s, d), AS_OF)


def v_failure_rates(s, d):
    return validators.failure_rates(validators.validations(checked_fields(s, d), AS_OF))


QUERIES = {f.__name__: f for f in (v_validation, v_failure_rates)}

_SLIP = f"SELECT application_id, {_G} AS gross_salary, {_N} AS net_salary, {_T} AS total_deductions, list_sum([i.a for i in {_parts(x.EARNINGS)}]) AS earnings_sum, {_columns('SALARY_SLIP')['month_year']} AS month_year FROM (SELECT *, coalesce(text, '') AS t FROM doc_texts WHERE true_type = 'SALARY_SLIP')"
_TAX = f"SELECT application_id, {_columns('FORM_16')['assessment_year']} AS assessment_year, {_columns('FORM_16')['financial_year']} AS financial_year FROM (SELECT *, coalesce(text, '') AS t FROM doc_texts WHERE true_type = 'FORM_16')"
_MONTH = "coalesce(try_strptime(concat('1 ', regexp_replace(trim(month_year), '[-,]\\s*', ' ', 'g')), ['%d %B %Y', '%d %b %Y']), try_strptime(concat('1/', month_year), ['%d/%m/%Y']))"
_BORN = "CAST(coalesce(try_strptime(trim(dob), ['%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d'])) AS DATE)"
_YEAR = "CASE WHEN regexp_matches(trim(dob), '^[0-9]{4}$') THEN CAST(trim(dob) AS INT) END"
_INPUTS = f"""SELECT i.application_id, pan_text AS pan_number, upper(trim(pan_text)) AS pan, upper(left(split_part(name, ' ', -1), 1)) AS initial, dob_text AS dob, national_number AS aadhaar_number, upper(regexp_replace(national_number, '[ -]', '', 'g')) AS uid,
 branch_code, upper(trim(branch_code)) AS ifsc, coalesce(gross_salary, 0) AS g, coalesce(net_salary, 0) AS n, coalesce(total_deductions, 0) AS d, earnings_sum AS e, month_year, assessment_year AS ay, financial_year AS fy
FROM case_inputs i JOIN numbers USING (application_id) LEFT JOIN slip USING (application_id) LEFT JOIN tax USING (application_id)"""
_DATED = f"SELECT *, {_MONTH} AS m, {_BORN} AS born, {_YEAR} AS yob, CAST(left(ay, 4) AS INT) AS a0, CAST(left(fy, 4) AS INT) AS f0 FROM ({_INPUTS})"
_WORKED = f"SELECT *, (2024 - year(m)) * 12 + 6 - month(m) AS old, coalesce(date_sub('year', born, DATE '{AS_OF}'), 2024 - yob) AS years FROM ({_DATED})"


def _rows(*cases):
    """The first case that holds as a struct."""
    whens = " ".join(f"{f'WHEN {condition} THEN' if condition else 'ELSE'} {{'field': '{field}', 'is_valid': {str(valid).lower()}, 'severity': '{severity}', 'message': {message}}}" for condition, field, valid, severity, message in cases)
    return f"CASE {whens} END"


def _s(text):
    return "'" + text.replace("'", "''") + "'"


def _m(v):
    return f"'₹' || format('{{:,.2f}}', {v})"


_CHECKS = (
    _rows(
        ("coalesce(pan_number, '') = ''", "pan_number", False, "ERROR", _s("PAN Number is missing.")),
        (f"NOT regexp_matches(pan, '{validators.PAN}')", "pan_number", False, "ERROR", "'Invalid PAN format ''' || pan || '''. Must be 5 uppercase letters, 4 digits, 1 letter.'"),
        ("pan[4] <> 'P'", "pan_number", True, "WARNING", "'PAN entity type is ''' || pan[4] || ''' (Non-individual). Individual home loan applicant usually has ''P''.'"),
        ("initial <> '' AND pan[5] <> initial", "pan_number", True, "WARNING", "'PAN 5th character ''' || pan[5] || ''' does not match applicant surname initial ''' || initial || '''.'"),
        (None, "pan_number", True, "INFO", "'Valid PAN: ' || pan || ' (Individual)'"),
    ),
    _rows(
        ("coalesce(aadhaar_number, '') = ''", "aadhaar_number", False, "ERROR", _s("Aadhaar Number is missing.")),
        ("regexp_matches(uid, '^X{8}[0-9]{4}$')", "aadhaar_number", True, "INFO", _s("Valid Masked Aadhaar (complies with RBI/UIDAI data privacy).")),
        ("contains(uid, 'X')", "aadhaar_number", False, "ERROR", _s("Invalid masked Aadhaar format.")),
        ("regexp_matches(uid, '^[01][0-9]{11}$')", "aadhaar_number", False, "ERROR", _s("Aadhaar number cannot start with 0 or 1.")),
        ("regexp_matches(uid, '^[0-9]{12}$')", "aadhaar_number", True, "INFO", _s("Valid 12-digit Aadhaar number format.")),
        (None, "aadhaar_number", False, "ERROR", "'Invalid Aadhaar format: ''' || aadhaar_number || '''.'"),
    ),
    _rows(
        ("coalesce(branch_code, '') = ''", "ifsc_code", False, "ERROR", _s("Bank IFSC Code is missing.")),
        ("NOT regexp_matches(ifsc, '^[A-Z]{4}0[A-Z0-9]{6}$')", "ifsc_code", False, "ERROR", "'Invalid IFSC code ''' || ifsc || '''. Format must be 4 letters, ''0'', followed by 6 alphanumeric characters.'"),
        (None, "ifsc_code", True, "INFO", "'Valid IFSC Code: ' || ifsc"),
    ),
    _rows(
        ("g <= 0 OR n <= 0", "salary_math", False, "ERROR", _s("Gross or Net Salary is zero/missing.")),
        ("abs(g - d - n) > 2", "salary_math", False, "ERROR", f"'Payslip arithmetic mismatch: Gross (' || {_m('g')} || ') - Deductions (' || {_m('d')} || ') = ' || {_m('g - d')} || ', but Net Pay is ' || {_m('n')} || ' (Variance: ' || {_m('abs(g - d - n)')} || ')'"),
        ("e <> 0 AND abs(e - g) > 5", "salary_math", True, "WARNING", f"'Sum of itemized earnings (' || {_m('e')} || ') differs slightly from Gross Salary (' || {_m('g')} || ').'"),
        (None, "salary_math", True, "INFO", _s("Salary arithmetic perfectly reconciled (Gross = Net + Deductions).")),
    ),
    _rows(
        ("coalesce(month_year, '') = ''", "payslip_recency", False, "WARNING", _s("Payslip month/year was not found on the document.")),
        ("m IS NULL", "payslip_recency", False, "WARNING", "'Could not parse payslip date: ''' || month_year || '''.'"),
        ("old < 0", "payslip_recency", False, "WARNING", f"'Payslip for ' || month_year || ' is dated in the future relative to today ({AS_OF}).'"),
        ("old > 3", "payslip_recency", False, "WARNING", "'Payslip for ' || month_year || ' is ' || old || ' months old, outside the required last-3-months window.'"),
        (None, "payslip_recency", True, "INFO", "'Payslip for ' || month_year || ' is within the last 3 months.'"),
    ),
    _rows(
        ("coalesce(ay, '') = '' OR coalesce(fy, '') = ''", "assessment_year", True, "INFO", _s("AY or FY not provided.")),
        ("a0 <> f0 + 1", "assessment_year", False, "ERROR", "'Assessment Year ''' || ay || ''' is inconsistent with Financial Year ''' || fy || ''' (Expected AY ' || (f0 + 1) || '-' || right(CAST(f0 + 2 AS VARCHAR), 2) || ').'"),
        (None, "assessment_year", True, "INFO", "'Valid AY ' || ay || ' for FY ' || fy || '.'"),
    ),
    _rows(
        ("coalesce(dob, '') = ''", "dob", False, "ERROR", _s("Date of Birth is missing.")),
        ("born IS NULL AND yob IS NOT NULL", "dob", True, "INFO", "'Calculated age from YOB: ' || years || ' years.'"),
        ("born IS NULL", "dob", False, "WARNING", "'Could not parse DOB format: ''' || dob || '''.'"),
        ("years < 21", "age", False, "ERROR", "'Applicant age (' || years || ' yrs) is below minimum underwriting threshold (21 yrs).'"),
        ("years > 65", "age", False, "WARNING", "'Applicant age (' || years || ' yrs) exceeds standard loan maturity threshold (65 yrs).'"),
        (None, "age", True, "INFO", "'Applicant age is ' || years || ' years (within eligible 21-65 range).'"),
    ),
)
_LONG = f"SELECT application_id, i.field AS field, i.is_valid AS is_valid, i.severity AS severity, i.message AS message FROM (SELECT application_id, unnest([{', '.join(_CHECKS)}]) AS i FROM ({_WORKED}))"


def _o(sql):
    return oracle(sql, "case_inputs", "doc_texts", numbers=NUMBERS, slip=_SLIP, tax=_TAX, long=_LONG)


ORACLE = {
    "v_validation": _o("SELECT * FROM long"),
    "v_failure_rates": _o(f"SELECT field, count(*) AS n, count(*) FILTER (WHERE NOT is_valid) AS n_failed, count(*) FILTER (WHERE severity = 'WARNING') AS n_warnings, {r('100.0::DOUBLE * count(*) FILTER (WHERE NOT is_valid) / count(*)', 2)} AS failure_rate FROM long GROUP BY 1"),
}
