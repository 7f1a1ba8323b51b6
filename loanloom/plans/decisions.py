"""Decision queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.functions.columns import joined
from loanloom.operators import decision, monitoring, reports
from loanloom.plans.compliance import COMPLIANCE_SQL
from loanloom.plans.credit import CREDIT_SQL, assessed
from loanloom.plans.sql import r

PARTS = [f"part_{name}" for name in ("credit", "foir", "ltv", "property", "documents", "stability")]


def cases(s, d):
    return assessed(s, d), view(s, d, "case_inputs")


@once
def evaluated(s, d):
    return decision.evaluated(*cases(s, d))


@once
def decided(s, d):
    return decision.finalised(evaluated(s, d))


@once
def staged(s, d):
    return decision.finalised(decision.recommended(evaluated(s, d)), F.col("roles_disagree"))


def v09_validation(s, d):
    found = decision.validated(decision.joined_cases(*cases(s, d)))
    status = [F.element_at("upstream_status", name).alias(name) for name in decision.REQUIRED]
    return found.select("application_id", "is_complete", joined(F.col("missing_fields")).alias("missing_fields"), F.array_join("warnings", "; ").alias("warnings"), *status)


def j11_contradictions(s, d):
    return decision.contradictions(decision.joined_cases(*cases(s, d)))


def a57_risk_components(s, d):
    lists = [F.array_join(x, "; ").alias(x) for x in ("positive_factors", "risk_factors")]
    return evaluated(s, d).select("application_id", *PARTS, "decision_score", *lists)


def a58_decision_confidence(s, d):
    return evaluated(s, d).select("application_id", F.round("completeness", 3).alias("completeness"), "n_high", "material", F.col("stated_confidence").alias("confidence"))


def a59_roles(s, d):
    return decision.recommended(evaluated(s, d)).select(
        "application_id", "underwriter", "analyst", "report_writer", "underwriter_confidence", "analyst_confidence", "report_writer_confidence", "analyst_reasoning", "roles_disagree"
    )


def a60_gates(s, d):
    return decided(s, d).groupBy(F.coalesce("gate", F.lit("none")).alias("gate"), "decision", F.coalesce("compliance_status", F.lit("")).alias("compliance_status")).agg(F.count("*").alias("n"))


def a61_decision(s, d):
    return decided(s, d).select("application_id", "gate", "decision_score", "confidence", "risk_level", "decision", "rationale")


def a62_full_stage(s, d):
    return staged(s, d).select("application_id", "gate", "decision", "underwriter", "analyst", "human_review", "rationale")


def a63_report(s, d):
    found = decision.report(staged(s, d))
    paths = {"decision": "application_summary.decision", "borrower": "borrower_summary.name", "documents": "document_verification.status", "stability": "credit_assessment.income_stability", "kyc": "compliance.kyc_cdd", "level": "risk_score_section.level", "recommendation": "final_recommendation", "human_review": "human_review_status"}
    return found.select("application_id", *[F.get_json_object("report", f"$.{path}").alias(name) for name, path in paths.items()])


def a64_stages(s, d):
    return decision.stages(staged(s, d))


def a65_review_items(s, d):
    return decision.review_items(staged(s, d))


def v12_review_queue(s, d):
    return decided(s, d).where("decision = 'SUSPEND'").select("application_id", "gate")


def t06_newest_first(s, d):
    """Applications by creation, newest first, with their place in that order."""
    return reports.newest_first(decision.review_items(staged(s, d)).select("application_id", "item_id").join(view(s, d, "applications").select("application_id", "created_at"), "application_id"), "created_at", "item_id")


def a05_credit_final_matrix(s, d):
    return monitoring.agreement(_both(s, d), "preliminary_decision", "decision")


def _both(s, d):
    return decided(s, d).select("application_id", "preliminary_decision", "decision")


def a05_off_diagonal(s, d):
    return monitoring.off_diagonal(_both(s, d), "preliminary_decision", "decision")


def a05_agreement_rate(s, d):
    return monitoring.agreement_rate(_both(s, d), "preliminary_decision", "decision")


QUERIES = {
    f.__name__: f
    for f in (v09_validation, j11_contradictions, a57_risk_components, a58_decision_confidence, a59_roles, a60_gates, a61_decision, a62_full_stage, a63_report, a64_stages,
              a65_review_items, v12_review_queue, t06_newest_first, a05_credit_final_matrix, a05_off_diagonal, a05_agreement_rate)
}

_DIFF = "coalesce(abs({0} - {1}) * 100 / nullif(greatest(abs({0}), abs({1})), 0), 0)".format
_CASE = ", ".join(f"CASE WHEN i.has_documents THEN i.{x} END AS {x}" for x in ("n_missing_documents", "extraction_confidence", "verification_status", "n_provenance", "doc_monthly_income", "reported_severity", "reported_resolution"))
_PROPERTY = ", ".join(f"CASE WHEN i.has_property THEN i.{x} END AS {x}" for x in ("estimated_value", "valuation_confidence", "valuation_variance_percent", "rera_status"))
JOINED_SQL = f"""SELECT c.application_id, c.monthly_income, c.property_value, c.cibil_score, c.credit_band, c.risk_tier, c.foir, coalesce(c.ltv, CASE WHEN c.property_value > 0 THEN c.loan_amount / c.property_value END) AS ltv, c.income_stability, c.credit_confidence, c.flags, c.n_flags, c.preliminary_decision, c.created_at,
 i.name, i.monthly_income AS profile_income, i.declared_cibil, i.loan_amount, {_CASE}, {_PROPERTY}, i.has_documents, i.has_property, k.n_critical, k.critical_flags, k.compliance_confidence, k.kyc_cdd,
 concat_ws(',', CASE WHEN NOT i.has_documents THEN 'document_analysis' END, CASE WHEN NOT i.has_property THEN 'property_analysis' END) AS missing_fields
 FROM credit c JOIN case_inputs i ON c.application_id = i.application_id JOIN comp k ON k.application_id = c.application_id"""


def _pairs(select):
    return " UNION ALL ".join(select.format(n=n, d=_DIFF(a, b), t=t, h=h) for n, a, b, t, h in decision.PAIRS)


CONTRADICTIONS_SQL = (
    _pairs("SELECT application_id, '{n}' AS field, " + r("{d}", 4) + " AS difference, CASE WHEN {d} > {h} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'UNRESOLVED' AS resolution FROM joined WHERE {d} > {t}")
    + " UNION ALL SELECT application_id, 'reported', NULL, reported_severity, reported_resolution FROM joined WHERE reported_severity IS NOT NULL"
)


def _ratio(column, name, bounds):
    steps = " ".join(f"WHEN {column} <= {b}::DOUBLE THEN concat('{w} {name} (', {_pct(column)}, ')')" for b, w in zip(bounds, ("Excellent", "Good", "Moderate", "High"), strict=True))
    missing = {"FOIR": "FOIR not available", "LTV": "LTV not calculable"}[name]
    return f"CASE WHEN {column} IS NULL THEN '{missing}' {steps} ELSE concat('Very high {name} (', {_pct(column)}, ')') END"


def _pct(x):
    return f"concat(CAST(CAST({r(f'{x} * 100', 0)} AS BIGINT) AS VARCHAR), '%')"


_V, _E, _M = "coalesce(valuation_confidence, 0)", "coalesce(extraction_confidence, 0)", "coalesce(n_missing_documents, 0)"
_FACTORS = f"""list_filter([CASE WHEN cibil_score IS NULL THEN 'No CIBIL score available' ELSE concat(CASE WHEN cibil_score >= 750 THEN 'Excellent' WHEN cibil_score >= 700 THEN 'Good' WHEN cibil_score >= 650 THEN 'Fair' WHEN cibil_score >= 550 THEN 'Below-average' ELSE 'Poor' END, ' CIBIL score (', cibil_score, ')') END,
 CASE risk_tier WHEN 'low' THEN 'Low credit risk tier' WHEN 'high' THEN 'High credit risk tier' END, {_ratio("foir", "FOIR", (0.3, 0.4, 0.5, 0.6))}, {_ratio("ltv", "LTV", (0.6, 0.7, 0.8, 0.9))},
 concat(CASE WHEN {_V} >= 0.8::DOUBLE THEN 'High' WHEN {_V} >= 0.6::DOUBLE THEN 'Moderate' WHEN {_V} >= 0.4::DOUBLE THEN 'Low' ELSE 'Very low' END, ' valuation confidence (', {_pct(_V)}, ')'),
 CASE rera_status WHEN 'registered' THEN 'RERA registered property' WHEN 'not_registered' THEN 'Property not RERA registered' END,
 CASE WHEN abs(valuation_variance_percent) > 20 THEN printf('High valuation variance (%.1f%%)', valuation_variance_percent) END,
 CASE WHEN {_M} = 0 THEN 'All required documents present' WHEN {_M} <= 2 THEN concat({_M}, ' document(s) missing') ELSE concat({_M}, ' documents missing') END,
 CASE WHEN {_E} >= 0.8::DOUBLE THEN 'High extraction confidence' WHEN {_E} < 0.5::DOUBLE THEN 'Low extraction confidence' END, CASE WHEN verification_status = 'verified' THEN 'Documents verified' END,
 CASE income_stability WHEN 'stable' THEN 'Stable income history' WHEN 'moderately_stable' THEN 'Moderately stable income' WHEN 'unstable' THEN 'Unstable income' ELSE 'Income stability unknown' END], lambda f: f IS NOT NULL)"""


def _about(words):
    return "(" + " OR ".join(f"contains(lower(f), '{w}')" for w in words) + ")"


_ANALYST = "n_critical > 0 OR n_critical_open > 0 OR decision_score < 50 OR stated < 0.8::DOUBLE"
EVALUATED_SQL = f"""SELECT *, CASE WHEN n_critical > 0 THEN 'SUSPEND' WHEN decision_score >= 80 AND stated >= 0.85::DOUBLE THEN 'APPROVE' WHEN decision_score <= 40 AND stated >= 0.85::DOUBLE THEN 'DENY' ELSE 'SUSPEND' END AS underwriter,
 CASE WHEN {_ANALYST} THEN 'SUSPEND' WHEN decision_score >= 85 AND stated >= 0.9::DOUBLE THEN 'APPROVE' ELSE 'SUSPEND' END AS analyst,
 CASE WHEN {_ANALYST} THEN 0.9 WHEN decision_score >= 85 AND stated >= 0.9::DOUBLE THEN 0.85 ELSE 0.75 END::DOUBLE AS analyst_confidence,
 concat_ws(' ', 'Independent risk assessment:', CASE WHEN n_critical_open > 0 THEN 'Unresolved critical contradiction requires suspension.' END, CASE WHEN n_critical > 0 THEN 'Critical compliance issue blocks approval.' END,
  CASE WHEN decision_score < 50 THEN printf('Risk score (%.1f) below comfort threshold.', decision_score) END, CASE WHEN stated < 0.8::DOUBLE THEN printf('Confidence (%.2f) insufficient for decisive action.', {r("stated", 2)}) END, CASE WHEN n_flags > 0 THEN concat('Credit flags (', n_flags, ') elevate risk profile.') END) AS analyst_reasoning,
 concat_ws(' ', CASE WHEN n_critical > 0 THEN 'Critical compliance flag triggers mandatory suspend.' WHEN decision_score >= 80 THEN printf('Strong risk score (%.1f/100) supports approval.', decision_score) WHEN decision_score <= 40 THEN printf('Weak risk score (%.1f/100) warrants denial.', decision_score) ELSE printf('Risk score (%.1f/100) falls in review zone.', decision_score) END,
  CASE WHEN n_flags > 0 THEN concat('Credit flags present: ', replace(flags, ',', ', '), '.') END) AS underwriter_reasoning FROM (
 SELECT *, CASE WHEN risk_failed THEN 0 ELSE {r("part_credit * 0.25::DOUBLE + part_foir * 0.2::DOUBLE + part_ltv * 0.15::DOUBLE + part_property * 0.15::DOUBLE + part_documents * 0.15::DOUBLE + part_stability * 0.1::DOUBLE", 1)} END AS decision_score,
  {r("greatest(0, least(1, 0.5::DOUBLE + 0.25::DOUBLE * completeness + 0.15::DOUBLE * coalesce(list_avg([x for x in [credit_confidence, valuation_confidence, compliance_confidence, extraction_confidence] if x > 0]), 0) + 0.2::DOUBLE * least(coalesce(n_provenance, 0) / 10.0::DOUBLE, 1) - 0.1::DOUBLE * n_high - CASE WHEN material THEN 0.1::DOUBLE ELSE 0 END - least(0.05::DOUBLE * n_critical, 0.15::DOUBLE)))", 4)} AS stated,
  CASE WHEN risk_failed THEN [] ELSE [f for f in factors if {_about(decision.POSITIVE)}] END AS positive_factors, CASE WHEN risk_failed THEN ['Risk calculation failure'] ELSE [f for f in factors if NOT {_about(decision.POSITIVE)} AND {_about(decision.NEGATIVE)}] END AS risk_factors FROM (
 SELECT j.*, {_FACTORS} AS factors, (5 - CAST(NOT has_documents AS INT) - CAST(NOT has_property AS INT)) / 5.0::DOUBLE AS completeness,
  coalesce(has_property AND (valuation_confidence IS NULL OR valuation_variance_percent IS NULL) OR has_documents AND extraction_confidence IS NULL, false) AS risk_failed,
  greatest(0, least(100, 50 + CASE WHEN cibil_score IS NULL THEN -20 WHEN cibil_score >= 750 THEN 30 WHEN cibil_score >= 700 THEN 20 WHEN cibil_score >= 650 THEN 5 WHEN cibil_score >= 550 THEN -10 ELSE -30 END + CASE risk_tier WHEN 'low' THEN 10 WHEN 'high' THEN -15 ELSE 0 END))::DOUBLE AS part_credit,
  CASE WHEN foir IS NULL THEN 50 WHEN foir <= 0.3::DOUBLE THEN 95 WHEN foir <= 0.4::DOUBLE THEN 80 WHEN foir <= 0.5::DOUBLE THEN 60 WHEN foir <= 0.6::DOUBLE THEN 35 ELSE 15 END::DOUBLE AS part_foir,
  CASE WHEN ltv IS NULL THEN 50 WHEN ltv <= 0.6::DOUBLE THEN 95 WHEN ltv <= 0.7::DOUBLE THEN 80 WHEN ltv <= 0.8::DOUBLE THEN 60 WHEN ltv <= 0.9::DOUBLE THEN 35 ELSE 15 END::DOUBLE AS part_ltv,
  greatest(0, least(100, CASE WHEN {_V} >= 0.8::DOUBLE THEN 90 WHEN {_V} >= 0.6::DOUBLE THEN 70 WHEN {_V} >= 0.4::DOUBLE THEN 45 ELSE 20 END + CASE rera_status WHEN 'registered' THEN 10 WHEN 'not_registered' THEN -10 ELSE 0 END) - CASE WHEN abs(valuation_variance_percent) > 20 THEN 15 ELSE 0 END)::DOUBLE AS part_property,
  least(100, CASE WHEN {_M} = 0 THEN 85 WHEN {_M} <= 2 THEN 60 ELSE 30 END + CASE WHEN {_E} >= 0.8::DOUBLE THEN 10 WHEN {_E} < 0.5::DOUBLE THEN -10 ELSE 0 END + CASE WHEN verification_status = 'verified' THEN 5 ELSE 0 END)::DOUBLE AS part_documents,
  CASE income_stability WHEN 'stable' THEN 90 WHEN 'moderately_stable' THEN 70 WHEN 'unstable' THEN 35 ELSE 50 END::DOUBLE AS part_stability,
  coalesce(n.n_high, 0) AS n_high, coalesce(n.n_unresolved, 0) AS n_unresolved, coalesce(n.n_critical_open, 0) AS n_critical_open,
  coalesce(doc_monthly_income <> 0 AND monthly_income <> 0 AND abs(doc_monthly_income - monthly_income) / greatest(doc_monthly_income, 1) >= 0.1::DOUBLE, false) OR coalesce(estimated_value <> 0 AND property_value <> 0 AND abs(estimated_value - property_value) / greatest(estimated_value, 1) >= 0.1::DOUBLE, false) AS material
 FROM joined j LEFT JOIN (SELECT application_id, count(*) AS n_high, count(*) FILTER (WHERE resolution = 'UNRESOLVED') AS n_unresolved, count(*) FILTER (WHERE severity = 'CRITICAL' AND resolution = 'UNRESOLVED') AS n_critical_open FROM contra WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY 1) n ON n.application_id = j.application_id))"""


def _decided(disagree):
    return f"""SELECT *, CASE WHEN gate IS NOT NULL THEN 'SUSPEND' WHEN decision_score >= 80 THEN 'APPROVE' WHEN decision_score <= 40 THEN 'DENY' ELSE 'SUSPEND' END AS decision,
 CASE WHEN decision_score >= 80 THEN 'LOW' WHEN decision_score >= 60 THEN 'MODERATE' WHEN decision_score >= 40 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk_level,
 CASE gate WHEN 'missing_inputs' THEN concat('Required inputs missing: ', replace(missing_fields, ',', ', ')) WHEN 'critical_compliance' THEN 'Critical compliance flag present → SUSPEND' WHEN 'contradiction' THEN 'Unresolved critical contradiction → SUSPEND'
  WHEN 'low_confidence' THEN concat(printf('Confidence %.3f', {r("confidence", 3)}), ' < threshold 0.85 → SUSPEND') WHEN 'crew_disagreement' THEN 'Material crew disagreement → SUSPEND' WHEN 'risk_failure' THEN 'Required risk calculation failed → SUSPEND'
  ELSE concat(printf('Risk score %.1f', decision_score), CASE WHEN decision_score >= 80 THEN ' >= approval threshold 80 → APPROVE' WHEN decision_score <= 40 THEN ' <= denial threshold 40 → DENY' ELSE ' in review zone (40-80) → SUSPEND' END) END AS rationale FROM (
 SELECT * EXCLUDE (decision_score), CASE WHEN missing_fields <> '' THEN 0 ELSE decision_score END AS decision_score, CASE WHEN missing_fields <> '' THEN 0 ELSE stated END AS confidence,
 CASE WHEN missing_fields <> '' THEN 'missing_inputs' WHEN n_critical > 0 THEN 'critical_compliance' WHEN n_unresolved > 0 THEN 'contradiction' WHEN stated < 0.85::DOUBLE THEN 'low_confidence' WHEN {disagree} THEN 'crew_disagreement' WHEN risk_failed THEN 'risk_failure' END AS gate FROM evaluated)"""


CHAIN = {"credit": CREDIT_SQL, "comp": COMPLIANCE_SQL, "joined": JOINED_SQL, "contra": CONTRADICTIONS_SQL, "evaluated": EVALUATED_SQL, "decided": _decided("false"), "staged": _decided("underwriter <> analyst")}


def _o(sql):
    return oracle(sql, "case_inputs", **CHAIN)


_ITEMS = """SELECT application_id, CASE WHEN len(items) > 0 THEN items WHEN decision <> 'APPROVE' THEN [concat('Decision requires human review|Medium|Decision Agent|', rationale)] ELSE [] END AS items FROM (
 SELECT *, list_concat([concat('Critical compliance flag|High|Compliance Agent|', f) for f in critical_flags], list_filter([
  CASE WHEN reported_severity IS NOT NULL THEN concat('Cross-document contradiction|', CASE WHEN reported_severity IN ('HIGH', 'CRITICAL') THEN 'High' ELSE 'Medium' END, '|Document Agent|reported by the documents') END,
  CASE WHEN n_missing_documents > 0 THEN concat('Missing documents|Medium|Document Agent|Missing: ', n_missing_documents) END,
  CASE WHEN coalesce(estimated_value, 0) <= 0 THEN 'Property valuation unavailable|High|Property Agent|No comparable listings were found.' END], lambda x: x IS NOT NULL)) AS items FROM staged)"""
_ROWS = f"SELECT application_id, concat('RV-', application_id, '-', k) AS item_id, split_part(x, '|', 1) AS title, split_part(x, '|', 2) AS severity, split_part(x, '|', 3) AS owner, split_part(x, '|', 4) AS evidence FROM (SELECT application_id, generate_subscripts(items, 1) AS k, unnest(items) AS x FROM ({_ITEMS}))"
_MONEY = f"CASE WHEN estimated_value >= 10000000 THEN printf('₹%.2f Cr', {r('estimated_value / 10000000', 2)}) WHEN estimated_value >= 100000 THEN printf('₹%.2f L', {r('estimated_value / 100000', 2)}) ELSE concat('₹', format('{{:,}}', CAST({r('estimated_value', 0)} AS BIGINT))) END"
_STAGES = f"""SELECT application_id, 0 AS place, 'Document Ingestion' AS stage, extraction_confidence AS confidence, CASE WHEN n_missing_documents > 0 OR reported_severity IS NOT NULL THEN 'Flagged' ELSE 'Complete' END AS status, concat('Verification: ', coalesce(verification_status, 'unknown')) AS subtitle FROM staged
UNION ALL SELECT application_id, 1, 'Credit Analysis', credit_confidence, CASE WHEN credit_confidence IS NULL THEN 'Flagged' ELSE 'Complete' END, concat('CIBIL ', coalesce(CAST(cibil_score AS VARCHAR), '—'), ' · ', coalesce(credit_band, '—')) FROM staged
UNION ALL SELECT application_id, 2, 'Property Valuation', valuation_confidence, CASE WHEN estimated_value > 0 THEN 'Complete' ELSE 'Flagged' END, CASE WHEN estimated_value > 0 THEN concat('Estimated ', {_MONEY}) ELSE 'No valuation available' END FROM staged
UNION ALL SELECT application_id, 3, 'Compliance', compliance_confidence, CASE WHEN n_critical > 0 THEN 'Hard gate' ELSE 'Complete' END, CASE WHEN n_critical > 0 THEN concat(n_critical, ' critical flag(s)') ELSE 'All hard-gate checks passed' END FROM staged
UNION ALL SELECT application_id, 4, 'Decision', confidence, CASE WHEN decision = 'SUSPEND' THEN 'Flagged' ELSE 'Complete' END, concat(decision, ' · risk ', printf('%.1f', decision_score)) FROM staged"""
_WHOLE = "missing_fields = ''"
_MAP = "CASE preliminary_decision WHEN 'APPROVE' THEN 'APPROVE' WHEN 'CONDITIONAL' THEN 'SUSPEND' WHEN 'REJECT' THEN 'DENY' END"
ORACLE = {
    "v09_validation": _o("""SELECT application_id, missing_fields = '' AS is_complete, missing_fields, concat_ws('; ', CASE WHEN profile_income <= 0 THEN 'borrower_profile.monthly_income is not positive' END, CASE WHEN n_missing_documents > 0 THEN 'Missing documents' END, CASE WHEN n_missing_documents > 3 THEN 'Many documents missing — income/asset verification may be unreliable' END, CASE WHEN n_critical > 0 THEN 'Compliance critical flags present' END) AS warnings,
 'PRESENT' AS borrower_profile, CASE WHEN has_documents THEN 'PRESENT' ELSE 'MISSING' END AS document_analysis, 'PRESENT' AS credit_analysis, CASE WHEN has_property THEN 'PRESENT' ELSE 'MISSING' END AS property_analysis, 'PRESENT' AS compliance_analysis FROM joined"""),
    "j11_contradictions": _o("SELECT * FROM contra"),
    "a57_risk_components": _o(f"SELECT application_id, {', '.join(PARTS)}, decision_score, array_to_string(positive_factors, '; ') AS positive_factors, array_to_string(risk_factors, '; ') AS risk_factors FROM evaluated"),
    "a58_decision_confidence": _o("SELECT application_id, round(completeness, 3) AS completeness, n_high, material, stated AS confidence FROM evaluated"),
    "a59_roles": _o(f"""SELECT application_id, CASE WHEN {_WHOLE} THEN underwriter END AS underwriter, CASE WHEN {_WHOLE} THEN analyst END AS analyst, CASE WHEN {_WHOLE} THEN underwriter END AS report_writer, {_WHOLE} AND underwriter <> analyst AS roles_disagree, CASE WHEN {_WHOLE} THEN analyst_confidence END AS analyst_confidence, CASE WHEN {_WHOLE} THEN analyst_reasoning END AS analyst_reasoning,
 CASE WHEN {_WHOLE} THEN CASE WHEN n_critical > 0 THEN 0.95 WHEN underwriter = 'APPROVE' THEN 0.9 WHEN underwriter = 'DENY' THEN 0.85 ELSE 0.7 END END::DOUBLE AS underwriter_confidence, CASE WHEN {_WHOLE} THEN CASE WHEN n_critical > 0 THEN 0.95 WHEN underwriter = 'APPROVE' THEN 0.9 WHEN underwriter = 'DENY' THEN 0.85 ELSE 0.8 END END::DOUBLE AS report_writer_confidence FROM evaluated"""),
    "a60_gates": _o("SELECT coalesce(gate, 'none') AS gate, decision, CASE WHEN gate = 'critical_compliance' THEN 'BLOCKED' WHEN gate IS NULL AND decision <> 'SUSPEND' THEN 'PASS' ELSE '' END AS compliance_status, count(*) AS n FROM decided GROUP BY 1, 2, 3"),
    "a61_decision": _o("SELECT application_id, gate, decision_score, confidence, risk_level, decision, rationale FROM decided"),
    "a62_full_stage": _o(f"SELECT application_id, gate, decision, CASE WHEN {_WHOLE} THEN underwriter END AS underwriter, CASE WHEN {_WHOLE} THEN analyst END AS analyst, decision <> 'APPROVE' AS human_review, rationale FROM staged"),
    "a63_report": _o(f"SELECT application_id, decision, name AS borrower, coalesce(verification_status, 'unknown') AS documents, income_stability AS stability, kyc_cdd AS kyc, risk_level AS level, concat(rationale, CASE WHEN {_WHOLE} THEN concat(' | Crew: Underwriter: ', underwriter_reasoning, ' | Risk Analyst: ', analyst_reasoning) ELSE '' END) AS recommendation, CASE WHEN decision = 'APPROVE' THEN 'NOT_REQUIRED' ELSE 'REQUIRED' END AS human_review FROM staged"),
    "a64_stages": _o(_STAGES),
    "a65_review_items": _o(_ROWS),
    "v12_review_queue": _o("SELECT application_id, gate FROM decided WHERE decision = 'SUSPEND'"),
    "t06_newest_first": _o(f"SELECT item_id, place FROM (SELECT item_id, row_number() OVER (ORDER BY created_at DESC, item_id) AS place FROM ({_ROWS}) JOIN joined USING (application_id)) WHERE place <= 100"),
    "a05_credit_final_matrix": _o("SELECT p AS preliminary_decision, f AS decision, count(application_id) AS n FROM (VALUES ('APPROVE'), ('CONDITIONAL'), ('REJECT')) a(p) CROSS JOIN (VALUES ('APPROVE'), ('SUSPEND'), ('DENY')) b(f) LEFT JOIN decided ON preliminary_decision = p AND decision = f GROUP BY 1, 2"),
    "a05_off_diagonal": _o(f"SELECT application_id, preliminary_decision, decision, (preliminary_decision = 'APPROVE' AND decision = 'DENY') OR (preliminary_decision = 'REJECT' AND decision = 'APPROVE') AS severe FROM decided WHERE preliminary_decision IS NOT NULL AND {_MAP} <> decision"),
    "a05_agreement_rate": _o(f"SELECT count(*) FILTER (WHERE preliminary_decision IS NOT NULL) AS compared, count(*) FILTER (WHERE preliminary_decision IS NULL) AS skipped, {r(f'100.0::DOUBLE * count(*) FILTER (WHERE {_MAP} = decision) / count(*) FILTER (WHERE preliminary_decision IS NOT NULL)', 2)} AS agreement_rate_pct FROM decided"),
}
