"""Credit queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.operators import credit
from loanloom.plans.sql import r

D = "CAST({} AS DOUBLE)".format
_MULTIPLE = "CASE WHEN employment_bucket = 'salaried' THEN 6 ELSE 5 END"
#: The whole assessment in SQL, over applications.
CREDIT_SQL = f"""SELECT * REPLACE (CASE WHEN usable THEN credit_band END AS credit_band, CASE WHEN usable THEN risk_tier END AS risk_tier, CASE WHEN usable THEN obligations END AS obligations),
 CASE WHEN usable THEN least(foir_raw, 1) END AS foir, CASE WHEN usable THEN least(ltv_raw, 2) END AS ltv,
 CASE WHEN NOT usable THEN NULL WHEN n_severe >= 1 THEN 'unstable' WHEN employment_bucket = 'salaried' THEN 'stable' ELSE 'moderately_stable' END AS income_stability,
 CASE WHEN usable THEN {r(f"greatest({D(0)}, least({D(100)}, CASE credit_band WHEN 'Excellent' THEN {D(100)} WHEN 'Good' THEN {D(82)} WHEN 'Fair' THEN {D(62)} WHEN 'Poor' THEN {D(35)} WHEN 'Very Poor' THEN {D(10)} ELSE {D(50)} END * {D(0.45)} + greatest({D(0)}, least({D(100)}, {D(50)} - (foir_raw - foir_limit) / foir_limit * {D(100)})) * {D(0.35)} + greatest({D(0)}, {D(100)} - n_severe * {D(30)} - (n_flags - n_severe) * {D(12)}) * {D(0.2)}))", 2)} END AS risk_score,
 CASE WHEN usable THEN {r(f"greatest({D(0.3)}, {D(0.9)} - CASE WHEN cibil_score IS NULL THEN {D(0.3)} ELSE {D(0)} END - n_flags * {D(0.05)})", 2)} ELSE 0 END AS credit_confidence,
 CASE WHEN NOT usable THEN NULL WHEN coalesce(cibil_score < 550, false) AND NOT (foir_raw - foir_limit < {D(-0.1)} AND n_flags = 0) THEN 'REJECT' WHEN foir_raw - foir_limit > {D(0.15)} THEN 'REJECT' WHEN n_severe >= 2 THEN 'REJECT'
  WHEN coalesce(cibil_score < 550, false) OR foir_raw - foir_limit > 0 OR n_flags >= 1 OR credit_band = 'New-to-Credit' THEN 'CONDITIONAL' ELSE 'APPROVE' END AS preliminary_decision
FROM (SELECT *, CASE WHEN usable THEN {r("obligations / monthly_income", 4)} END AS foir_raw, concat_ws(',', f1, f2, f3, f4, f5) AS flags,
  concat_ws(', ', CASE WHEN f1 IS NOT NULL THEN concat(settled_accounts, ' settled account(s) found in credit history') END, CASE WHEN f2 IS NOT NULL THEN concat(written_off_accounts, ' written-off account(s) found in credit history') END,
   CASE WHEN f3 IS NOT NULL THEN concat('DPD exceeding 90 days in last 12 months (max DPD: ', max_dpd_last_12_months, ')') END, CASE WHEN f4 IS NOT NULL THEN concat('Possible loan stacking - ', recent_enquiries_last_90_days, ' credit enquiries in last 90 days') END,
   CASE WHEN f5 IS NOT NULL THEN concat('Requested loan amount (Rs.', format('{{:,}}', CAST(loan_amount AS BIGINT)), ') exceeds ', {_MULTIPLE}, 'x annual income (Rs.', format('{{:,}}', CAST(monthly_income * 12 AS BIGINT)), ') - income-to-loan mismatch') END) AS flag_texts,
  CAST((f1 IS NOT NULL) AS INT) + CAST((f2 IS NOT NULL) AS INT) + CAST((f3 IS NOT NULL) AS INT) + CAST((f4 IS NOT NULL) AS INT) + CAST((f5 IS NOT NULL) AS INT) AS n_flags,
  CAST((f1 IS NOT NULL) AS INT) + CAST((f2 IS NOT NULL) AS INT) + CAST((f3 IS NOT NULL) AS INT) AS n_severe
 FROM (SELECT *, {r("existing_debt + emi + card_emi", 2)} AS obligations, CASE WHEN property_value > 0 THEN {r("loan_amount / property_value", 4)} END AS ltv_raw,
   CASE credit_band WHEN 'Excellent' THEN 'low' WHEN 'Good' THEN 'low' WHEN 'Poor' THEN 'high' WHEN 'Very Poor' THEN 'high' ELSE 'moderate' END AS risk_tier,
   CASE WHEN employment_bucket = 'salaried' THEN {D(0.55)} ELSE {D(0.45)} END AS foir_limit,
   CASE WHEN usable AND settled_accounts > 0 THEN 'settled_account' END AS f1, CASE WHEN usable AND written_off_accounts > 0 THEN 'written_off_account' END AS f2,
   CASE WHEN usable AND max_dpd_last_12_months > 90 THEN 'dpd_over_90' END AS f3, CASE WHEN usable AND recent_enquiries_last_90_days >= 3 THEN 'loan_stacking' END AS f4,
   CASE WHEN usable AND loan_amount > monthly_income * 12 * {_MULTIPLE} THEN 'income_to_loan_mismatch' END AS f5
  FROM (SELECT *, CASE WHEN replace(replace(lower(trim(employment_type)), ' ', '_'), '-', '_') IN ('salaried', 'salary', 'employee', 'employed') THEN 'salaried'
     WHEN lower(trim(employment_type)) = 'business' THEN 'business' ELSE 'self_employed' END AS employment_bucket,
    CASE WHEN cibil_score IS NULL THEN 'New-to-Credit' WHEN cibil_score >= 750 THEN 'Excellent' WHEN cibil_score >= 700 THEN 'Good' WHEN cibil_score >= 650 THEN 'Fair' WHEN cibil_score >= 550 THEN 'Poor' ELSE 'Very Poor' END AS credit_band,
    CASE WHEN loan_tenure_months <= 0 THEN {D(0)} ELSE {r(f"loan_amount * ({D(8.5)} / 1200) * pow(1 + {D(8.5)} / 1200, loan_tenure_months) / (pow(1 + {D(8.5)} / 1200, loan_tenure_months) - 1)", 2)} END AS emi,
    {r(f"credit_card_outstanding_total * {D(0.05)}", 2)} AS card_emi FROM (SELECT * REPLACE (CASE WHEN monthly_income > 0 AND loan_amount > 0 AND loan_tenure_months > 0 THEN cibil_score END AS cibil_score), monthly_income > 0 AND loan_amount > 0 AND loan_tenure_months > 0 AS usable FROM applications))))"""


@once
def assessed(spark, sf_dir):
    return credit.assess(view(spark, sf_dir, "applications"))


#: Query -> its columns beside application_id.
COLUMNS = {
    "c01_employment_bucket": ["employment_bucket"],
    "c02_credit_band": ["credit_band"],
    "c03_risk_tier": ["credit_band", "risk_tier"],
    "c04_foir_limit": ["employment_bucket", "foir_limit"],
    "c05_emi": ["emi"],
    "c06_card_emi": ["card_emi"],
    "c07_obligations": ["obligations"],
    "c08_foir": ["foir_raw"],
    "c09_ltv": ["ltv_raw"],
    "c10_red_flags": ["flags", "flag_texts", "n_flags"],
    "c11_severe_flags": ["n_severe"],
    "c12_income_stability": ["income_stability"],
    "c13_risk_score": ["risk_score"],
    "c14_confidence": ["credit_confidence"],
    "c15_preliminary_decision": ["preliminary_decision"],
    "c16_credit_assessment": ["credit_band", "risk_tier", "foir", "ltv", "flags", "n_flags", "income_stability", "risk_score", "credit_confidence", "preliminary_decision"],
}


def _query(columns):
    def run(spark, sf_dir):
        lists = {"flags": ",", "flag_texts": ", "}
        return assessed(spark, sf_dir).select("application_id", *[F.array_join(c, lists[c]).alias(c) if c in lists else c for c in columns])

    return run


def c17_bureau_data(spark, sf_dir):
    return credit.bureau_data(view(spark, sf_dir, "case_inputs"), view(spark, sf_dir, "bureau_reports"))


def f14_flag_categories(spark, sf_dir):
    rows = assessed(spark, sf_dir).select(F.explode("flag_texts").alias("text"))
    return rows.groupBy(credit.flag_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


QUERIES = {name: _query(columns) for name, columns in COLUMNS.items()} | {f.__name__: f for f in (c17_bureau_data, f14_flag_categories)}
QUERIES["c18_explanation"] = lambda spark, sf_dir: credit.explanation(assessed(spark, sf_dir))
ORACLE = {name: oracle(f"SELECT application_id, {', '.join(columns)} FROM credit", "applications", credit=CREDIT_SQL) for name, columns in COLUMNS.items()}
ORACLE["c18_explanation"] = oracle(
    f"""SELECT application_id, concat_ws(' ', CASE WHEN cibil_score IS NOT NULL THEN concat('CIBIL score of ', cibil_score, ' places the applicant in the ', credit_band, ' band.') ELSE 'No credit history available; assessed as New-to-Credit.' END,
 CASE WHEN foir > 0.5::DOUBLE THEN printf('FOIR of %.1f%% exceeds typical thresholds, indicating high debt burden.', {r("foir * 100", 1)}) WHEN foir IS NOT NULL THEN printf('FOIR of %.1f%% is within acceptable limits.', {r("foir * 100", 1)}) END,
 CASE WHEN ltv > 0.8::DOUBLE THEN printf('LTV of %.1f%% is high, limiting equity cushion.', {r("ltv * 100", 1)}) WHEN ltv IS NOT NULL THEN printf('LTV of %.1f%% provides adequate collateral coverage.', {r("ltv * 100", 1)}) END,
 CASE WHEN n_flags > 0 THEN concat('Red flags detected: ', flag_texts, '.') ELSE 'No material red flags identified.' END,
 concat('Composite risk score: ', coalesce(CAST(risk_score AS VARCHAR), 'None'), '/100. Preliminary decision: ', coalesce(preliminary_decision, 'None'), '.')) AS explanation FROM credit""",
    "applications",
    credit=CREDIT_SQL,
)
ORACLE["c17_bureau_data"] = oracle(
    """SELECT application_id, CASE WHEN r IS NOT NULL THEN CASE WHEN score > 0 THEN score END WHEN declared_cibil BETWEEN 300 AND 900 THEN declared_cibil END AS cibil_score,
 CASE WHEN r IS NOT NULL THEN 'bureau' WHEN declared_cibil BETWEEN 300 AND 900 THEN 'applicant_declared' ELSE 'missing' END AS source, r IS NULL AND coalesce(declared_cibil NOT BETWEEN 300 AND 900, false) AS out_of_range, r IS NOT NULL AS verified,
 """ + ", ".join(f"CASE WHEN r IS NOT NULL OR declared_cibil BETWEEN 300 AND 900 THEN coalesce({x}, 0) END AS {x}" for x in credit._BUREAU) + """
FROM (SELECT i.application_id, i.declared_cibil, b.application_id AS r, b.cibil_score AS score, """ + ", ".join(f"b.{x}" for x in credit._BUREAU) + """ FROM case_inputs i LEFT JOIN bureau_reports b ON b.application_id = i.application_id)""",
    "case_inputs",
    "bureau_reports",
)
ORACLE["f14_flag_categories"] = oracle("SELECT category, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS category FROM credit WHERE flags <> '') GROUP BY 1", "applications", credit=CREDIT_SQL)
