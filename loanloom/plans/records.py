"""Queries of exports, cases, listing tables and whole reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import oracle, query, view
from loanloom.functions.names import token_sort_ratio
from loanloom.operators import benchmarks, monitoring, validators
from loanloom.plans import compliance
from loanloom.plans import monitoring as mp
from loanloom.plans.credit import assessed
from loanloom.plans.decisions import CHAIN, staged
from loanloom.plans.sql import r, sorted_words, subsequence
from loanloom.sources import records

AS_OF = "2024-06-30"
#: Applications as an export holds them: some flat, some with the decision in one or the other place.
EXPORTS = """SELECT CAST(application_id AS STRING) AS id, CASE WHEN application_id % 4 = 0 THEN NULL ELSE 'F' END AS gender, CAST(NULL AS STRING) AS created_at, outcome_bad,
 CASE WHEN application_id % 5 = 0 THEN NULL WHEN application_id % 5 = 1 THEN concat('{"id": "x", "gender": "M", "created_at": "2024", "decision": {"decision": "DENY", "confidence": 0.', CAST(application_id % 9 AS STRING), '}}')
  ELSE concat('{"gender": "M", "agents": {"credit": {"credit_band": "Good", "risk_score": ', CAST(application_id % 90 AS STRING), '.5, "flags": ["a", "b"]}, "decision": {"decision": "APPROVE"}}, "decision": {"decision": "SUSPEND"}}') END AS view FROM applications"""
DOCUMENTS = """SELECT application_id, concat('d', CAST(k AS STRING)) AS doc_id, CASE k WHEN 1 THEN 'AADHAAR_CARD' WHEN 2 THEN 'SALARY_SLIP' ELSE 'AADHAAR_CARD' END AS doc_type,
 CASE WHEN k = 1 AND application_id % 3 = 0 THEN NULL WHEN k = 3 THEN 'Female' WHEN k = 1 THEN 'Male' END AS gender, application_id % 7 <> 0 AS readable, CASE WHEN (application_id + k) % 5 = 0 THEN 'net_salary' END AS changed
FROM applications CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE application_id % 11 <> 0"""


def s02_exported(s, d):
    docs = query(s, d, DOCUMENTS, "applications").withColumn("overrides", F.when(F.col("changed").isNotNull(), F.array("changed")))
    found = records.exported(view(s, d, "applications").select("application_id"), docs)
    listed = F.array_join(F.transform(F.map_entries("field_overrides"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return found.select("application_id", "gender", listed.alias("field_overrides"))


def s03_normalised(s, d):
    found = records.normalised(query(s, d, EXPORTS, "applications"))
    return found.select("application_id", "gender", "created_at", F.col("credit.risk_score").alias("risk_score"), F.size("credit.flags").alias("n_flags"), F.col("decision.decision").alias("decision"), F.col("decision.confidence").alias("confidence"), "outcome_bad")


def s05_last_prediction(s, d):
    return records.last_of_each(view(s, d, "audit_log").select("application_id", "seq", "decision", "confidence"), "application_id", "seq")


#: Rows as a listing file has them, all text.
LISTING_FILE = """SELECT source AS source_platform, source_url AS listing_url, CASE WHEN listing_id % 9 = 0 THEN 'bangalore' ELSE lower(city) END AS city, locality, property_type_text AS property_type, CASE WHEN listing_id % 10 = 0 THEN '99999999999' WHEN listing_id % 10 = 1 THEN 'two' ELSE concat(CAST(1 + listing_id % 4 AS STRING), '.0') END AS bhk,
 CAST(bathrooms AS STRING) AS bathrooms, CASE WHEN listing_id % 12 = 0 THEN '' ELSE CAST(600 + listing_id % 400 AS STRING) END AS area_sqft, CASE WHEN listing_id % 13 = 0 THEN 'n/a' ELSE CAST(1000000 + listing_id AS STRING) END AS price_inr, CAST(total_floors AS STRING) AS total_floors FROM raw_listings"""


def listing_rows(s, d):
    return records.mapped(query(s, d, LISTING_FILE, "raw_listings"))


def s07_mapped(s, d):
    return listing_rows(s, d).select("source", "source_url", "city", "property_type", "bedrooms", "bathrooms", "area_sqft", "price_inr", "total_floors", "quality")


def s08_replaced(s, d):
    return records.replaceable(listing_rows(s, d))[1]


def s11_purged(s, d):
    raw = view(s, d, "raw_listings").withColumn("source", F.when(F.col("listing_id") % 100 == 3, "demo_source").otherwise(F.col("source")))
    return records.purged(raw, (1, 2, 3, 5, 8, 13))[1]


def s12_saved(s, d):
    log = view(s, d, "audit_log").select("application_id", "decision", F.col("seq").alias("saved_at"))
    found = records.saved(log.where("saved_at % 2 = 0"), log.where("saved_at % 2 = 1"))
    return found.select("application_id", "decision", "saved_at")


def s13_audit_of_one(s, d):
    """The log of one application."""
    return view(s, d, "audit_log").where("application_id = 7").select("seq", "decision", "gate_triggered")


def s16_pages(s, d):
    return view(s, d, "pages").select("page_id", "url", F.char_length("html").alias("html_chars"))


def labelled(s, d):
    """Cases with a truth, a third with a prediction of their own; predictions are the last audited decisions."""
    c = F.col
    rows = view(s, d, "applications").where("application_id % 3 <> 2").select("application_id", F.when(c("ltv_pct") > 80, "DENY").otherwise("APPROVE").alias("truth"), F.when(c("application_id") % 3 == 0, "SUSPEND").alias("predicted"))
    return records.predicted(rows, s05_last_prediction(s, d))


def j13_predicted(s, d):
    return labelled(s, d)[0].select("application_id", "truth", "predicted")


def u05_without_prediction(s, d):
    return labelled(s, d)[1]


def u03_shared_fields(s, d):
    """How many applications used each protected field, however it was written."""
    used = F.array_intersect(F.split(F.lower("fields_used"), ","), F.array(*map(F.lit, ("religion", "caste", "gender", "region"))))
    return view(s, d, "case_inputs").select(F.explode(used).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def v01_pan_format(s, d):
    found = validators.pan_checks(view(s, d, "case_inputs"), "pan_text", "name")
    return found.select("application_id", "pan_valid", "pan_not_individual", "pan_other_surname", "severity")


def v07_applicant_age(s, d):
    years = validators.age(F.col("dob_text"), AS_OF)
    return view(s, d, "case_inputs").select("application_id", years.alias("age"), validators.age_allowed(F.col("dob_text"), AS_OF).alias("age_allowed"))


def a42_name_matcher(s, d):
    return benchmarks.matcher(name_pairs(s, d), "score", "same")


def name_pairs(s, d):
    """Names on cards against those on forms; a card of someone else is not the same."""
    c = F.col
    rows = view(s, d, "case_inputs").where("pan_card_name is not null")
    return rows.select(token_sort_ratio(F.lower("name"), F.lower("pan_card_name")).alias("score"), (c("application_id") % 17 != 0).alias("same"))


def a43_rule_benchmark(s, d):
    """The flags found against those expected by rules stated on the inputs alone."""
    c = F.col
    found = compliance.checked(s, d)
    expected = F.filter(F.array(F.when(~c("source_of_funds_declared"), "PMLA_SOURCE_OF_FUNDS_MISSING"), F.when(~c("identity_verification_logged"), "PMLA_IDENTITY_LOG_MISSING"), F.when(c("under_construction") & (c("application_id") % 4 != 1), "RERA_NOT_REGISTERED"), F.when(c("application_id") % 53 == 0, "IDENTITY_MISMATCH_PAN")), lambda v: v.isNotNull())
    produced = F.array_intersect(F.transform("flags", lambda f: f["code"]), F.array(*map(F.lit, ("PMLA_SOURCE_OF_FUNDS_MISSING", "PMLA_IDENTITY_LOG_MISSING", "RERA_NOT_REGISTERED", "IDENTITY_MISMATCH_PAN"))))
    return benchmarks.flags(found.select(expected.alias("expected"), produced.alias("produced")))


def a45_evaluation(s, d):
    cases = mp.cases(s, d)
    return benchmarks.evaluation(cases.join(assessed(s, d).select("application_id", "risk_score"), "application_id"), mp.LABELS)


def a12_statuses(s, d):
    """The dashboard over final decisions."""
    status = F.when(F.col("decision") == "APPROVE", "Approved").when(F.col("decision") == "DENY", "Declined").otherwise("Needs Review")
    rows = staged(s, d).select(status.alias("status"), F.lit(1.0).alias("processing_seconds"), F.col("profile_loan").alias("loan_amount"))
    return monitoring.dashboard(rows).select("needs_review", "total", "approval_rate_pct", "portfolio_value")


QUERIES = {
    f.__name__: f
    for f in (s02_exported, s03_normalised, s05_last_prediction, s07_mapped, s08_replaced, s11_purged, s12_saved, s13_audit_of_one, s16_pages, j13_predicted, u05_without_prediction, u03_shared_fields,
              v01_pan_format, v07_applicant_age, a42_name_matcher, a43_rule_benchmark, a45_evaluation, a12_statuses)
}

_EXPORTED = "SELECT application_id, arg_min(gender, doc_id) FILTER (WHERE doc_type = 'AADHAAR_CARD' AND gender IS NOT NULL) AS gender, string_agg(doc_id || '=' || coalesce(changed, ''), ';' ORDER BY doc_id) FILTER (WHERE readable) AS o FROM docs GROUP BY 1"
_MAPPED = """SELECT source_platform AS source, listing_url AS source_url, locality, CASE WHEN city = 'bangalore' THEN 'Bengaluru' ELSE upper(left(city, 1)) || substring(city, 2) END AS city, CASE WHEN contains(lower(property_type), 'apartment') OR contains(lower(property_type), 'flat') THEN 'Apartment' WHEN contains(lower(property_type), 'villa') THEN 'Villa' WHEN contains(lower(property_type), 'house') THEN 'Independent House' ELSE 'Plot' END AS property_type,
 CASE WHEN TRY_CAST(bhk AS DOUBLE) <= 2147483647 THEN CAST(TRY_CAST(bhk AS DOUBLE) AS INT) END AS bedrooms, CAST(bathrooms AS INT) AS bathrooms, TRY_CAST(nullif(area_sqft, '') AS DOUBLE) AS area_sqft, TRY_CAST(price_inr AS DOUBLE) AS price_inr, CAST(total_floors AS INT) AS total_floors FROM file"""
_FILLED = " + ".join(f"CASE WHEN coalesce(CAST({n} AS VARCHAR), '') NOT IN ('', '0', '0.0') THEN {w} ELSE 0 END" for n, w in {"nullif(trim(locality), '')": 20, "price_inr": 20, "area_sqft": 15, "bedrooms": 10, "bathrooms": 5, "total_floors": 5}.items())
_PAN = "coalesce(regexp_matches(pan, '^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$'), false)"
_DOB = "coalesce(try_strptime(trim(dob_text), ['%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d']), NULL)"
_AGE = f"CASE WHEN {_DOB} IS NOT NULL THEN 2024 - year({_DOB}) - CASE WHEN (6, 30) < (month({_DOB}), day({_DOB})) THEN 1 ELSE 0 END WHEN regexp_matches(trim(dob_text), '^[0-9]{{4}}$') THEN 2024 - CAST(trim(dob_text) AS INT) END"
_RATIO = f"CASE WHEN w0 = w1 THEN 100 ELSE 200.0::DOUBLE * {subsequence('w0', 'w1')} / (length(w0) + length(w1)) END"
_NAMES = f"SELECT {_RATIO} AS score, application_id % 17 <> 0 AS same FROM (SELECT application_id, {sorted_words('lower(name)')} AS w0, {sorted_words('lower(pan_card_name)')} AS w1 FROM case_inputs WHERE pan_card_name IS NOT NULL)"
_LABELLED = "SELECT a.application_id, CASE WHEN ltv_pct > 80 THEN 'DENY' ELSE 'APPROVE' END AS truth, CASE WHEN a.application_id % 3 = 0 THEN 'SUSPEND' ELSE p.decision END AS predicted FROM applications a LEFT JOIN (SELECT application_id, arg_max(decision, seq) AS decision FROM audit_log GROUP BY 1) p ON p.application_id = a.application_id WHERE a.application_id % 3 <> 2"


def _div(a, b):
    return f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)"


_CODES = ("PMLA_SOURCE_OF_FUNDS_MISSING", "PMLA_IDENTITY_LOG_MISSING", "RERA_NOT_REGISTERED", "IDENTITY_MISMATCH_PAN")
_EXPECT = ("NOT source_of_funds_declared", "NOT identity_verification_logged", "under_construction AND application_id % 4 <> 1", "application_id % 53 = 0")
_FOUND = ["len([f for f in flags if starts_with(f, '" + c + "')]) > 0" for c in _CODES]
ORACLE = {
    "s02_exported": oracle(f"SELECT a.application_id, e.gender, CASE WHEN e.o IS NOT NULL THEN e.o END AS field_overrides FROM applications a LEFT JOIN ({_EXPORTED}) e ON e.application_id = a.application_id", "applications", docs=DOCUMENTS),
    "s03_normalised": oracle("SELECT id AS application_id, coalesce(gender, json_extract_string(view, '$.gender')) AS gender, json_extract_string(view, '$.created_at') AS created_at, CAST(json_extract_string(view, '$.agents.credit.risk_score') AS DOUBLE) AS risk_score, CASE WHEN json_extract_string(view, '$.agents.credit.credit_band') IS NOT NULL THEN 2 END AS n_flags, coalesce(json_extract_string(view, '$.agents.decision.decision'), json_extract_string(view, '$.decision.decision')) AS decision, CASE WHEN json_extract_string(view, '$.agents.decision.decision') IS NULL THEN CAST(json_extract_string(view, '$.decision.confidence') AS DOUBLE) END AS confidence, outcome_bad FROM exports", "applications", exports=EXPORTS),
    "s05_last_prediction": oracle("SELECT application_id, max(seq) AS seq, arg_max(decision, seq) AS decision, arg_max(confidence, seq) AS confidence FROM audit_log GROUP BY 1", "audit_log"),
    "s07_mapped": oracle(f"SELECT source, source_url, city, property_type, bedrooms, bathrooms, area_sqft, price_inr, total_floors, {r(f'least(100, 0.7::DOUBLE * ({_FILLED}) + 5 + 10)', 1)} AS quality FROM ({_MAPPED})", "raw_listings", file=LISTING_FILE),
    "s08_replaced": oracle(f"SELECT count(*) FILTER (WHERE coalesce(trim(locality), '') <> '' AND price_inr > 0) AS imported, count(*) - count(*) FILTER (WHERE coalesce(trim(locality), '') <> '' AND price_inr > 0) AS skipped FROM ({_MAPPED})", "raw_listings", file=LISTING_FILE),
    "s11_purged": oracle("SELECT count(*) FILTER (WHERE listing_id IN (1, 2, 3, 5, 8, 13)) AS bad_ids, count(*) FILTER (WHERE listing_id NOT IN (1, 2, 3, 5, 8, 13) AND listing_id % 100 = 3) AS demo_rows FROM raw_listings", "raw_listings"),
    "s12_saved": oracle("SELECT application_id, arg_max(decision, seq) AS decision, max(seq) AS saved_at FROM audit_log GROUP BY 1", "audit_log"),
    "s13_audit_of_one": oracle("SELECT seq, decision, gate_triggered FROM audit_log WHERE application_id = 7", "audit_log"),
    "s16_pages": oracle("SELECT page_id, url, length(html) AS html_chars FROM pages_of", pages_of="SELECT * FROM pages"),
    "j13_predicted": oracle(f"SELECT * FROM ({_LABELLED}) WHERE predicted IS NOT NULL", "applications", "audit_log"),
    "u05_without_prediction": oracle(f"SELECT application_id FROM ({_LABELLED}) WHERE predicted IS NULL", "applications", "audit_log"),
    "u03_shared_fields": oracle("SELECT field, count(*) AS n FROM (SELECT unnest(string_split(lower(fields_used), ',')) AS field FROM case_inputs) WHERE field IN ('religion', 'caste', 'gender', 'region') GROUP BY 1", "case_inputs"),
    "v01_pan_format": oracle(f"SELECT *, CASE WHEN NOT pan_valid THEN 'ERROR' WHEN pan_not_individual OR pan_other_surname THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT application_id, {_PAN} AS pan_valid, {_PAN} AND substring(pan, 4, 1) <> 'P' AS pan_not_individual, {_PAN} AND substring(pan, 4, 1) = 'P' AND coalesce(substring(pan, 5, 1) <> upper(substring(split_part(name, ' ', 2), 1, 1)), false) AS pan_other_surname FROM (SELECT *, upper(replace(pan_text, ' ', '')) AS pan FROM case_inputs))", "case_inputs"),
    "v07_applicant_age": oracle(f"SELECT application_id, CAST({_AGE} AS INT) AS age, CASE WHEN {_DOB} IS NOT NULL THEN {_AGE} BETWEEN 21 AND 65 ELSE coalesce(regexp_matches(trim(dob_text), '^[0-9]{{4}}$'), false) END AS age_allowed FROM case_inputs", "case_inputs"),
    "a42_name_matcher": oracle(f"SELECT CAST(t AS INT) AS threshold, tp, fp, fn, tn, {r(_div('tp', 'tp + fp'), 4)} AS precision, {r(_div('tp', 'tp + fn'), 4)} AS recall, {r(_div('2 * tp', '2 * tp + fp + fn'), 4)} AS f1 FROM (SELECT t, count(*) FILTER (WHERE score >= t AND same) AS tp, count(*) FILTER (WHERE score >= t AND NOT same) AS fp, count(*) FILTER (WHERE score < t AND same) AS fn, count(*) FILTER (WHERE score < t AND NOT same) AS tn FROM (VALUES (60), (70), (75), (80), (85), (90), (95), (100)) x(t) CROSS JOIN ({_NAMES}) GROUP BY 1)", "case_inputs"),
    "a43_rule_benchmark": oracle("SELECT code, tp, fn, fp, " + r(_div("tp", "tp + fp"), 4) + " AS precision, " + r(_div("tp", "tp + fn"), 4) + " AS recall FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER (WHERE ({e}) AND {f}) AS tp, count(*) FILTER (WHERE ({e}) AND NOT {f}) AS fn, count(*) FILTER (WHERE NOT ({e}) AND {f}) AS fp FROM comp" for c, e, f in zip(_CODES, _EXPECT, _FOUND, strict=True)) + ") WHERE tp + fn + fp > 0", "case_inputs", comp=CHAIN["comp"]),
}
