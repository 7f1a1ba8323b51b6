"""Compliance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.functions.columns import joined
from loanloom.functions.names import edit_distance, token_sort_ratio
from loanloom.operators import compliance as x
from loanloom.plans.sql import edits, r, sorted_words, subsequence


@once
def checked(spark, sf_dir):
    return x.checked(view(spark, sf_dir, "case_inputs"))


def k01_kyc(spark, sf_dir):
    return checked(spark, sf_dir).select("application_id", F.col("kyc_cdd").alias("kyc_status"), joined(F.col("missing_documents")).alias("missing_documents"))


def k02_identity(spark, sf_dir):
    rows = x.flag_table(checked(spark, sf_dir)).where("check = 'identity_consistency'")
    return rows.select("application_id", "code", "severity", "message")


def k03_pan_key(spark, sf_dir):
    return view(spark, sf_dir, "case_inputs").select("application_id", x.pan_key(F.col("pan_text")).alias("pan"))


def k04_birth_date(spark, sf_dir):
    return view(spark, sf_dir, "case_inputs").select("application_id", x.birth_date(F.col("aadhaar_dob")).alias("born"), x.birth_date(F.col("dob_text")).alias("stated"))


def k05_pmla(spark, sf_dir):
    return checked(spark, sf_dir).select("application_id", F.col("pmla_source_of_funds").alias("pmla_status"))


def k06_fair_practices(spark, sf_dir):
    return checked(spark, sf_dir).select("application_id", F.col("rbi_fair_practices").alias("status"), joined(F.col("protected_found")).alias("protected_found"))


def k07_priority_sector(spark, sf_dir):
    found = checked(spark, sf_dir)
    flagged = F.exists("flags", lambda f: f["code"] == "NHB_PRIORITY_SECTOR_MISCLASSIFIED")
    return found.select("application_id", "city_tier", "priority_sector_eligible", flagged.alias("flagged"))


def k08_rera(spark, sf_dir):
    return checked(spark, sf_dir).select("application_id", F.col("rera").alias("rera_check"))


def k11_rule_flags(spark, sf_dir):
    return x.flag_table(checked(spark, sf_dir)).select("application_id", F.col("place").cast("long").alias("place"), "code", "severity", "message")


def k11_rule_status(spark, sf_dir):
    status = x.rule_status(checked(spark, sf_dir))
    return status.select("application_id", *[F.element_at("rule_status", name).alias(name) for name in x.CHECKS])


def k12_compliance_confidence(spark, sf_dir):
    return checked(spark, sf_dir).select("application_id", "n_critical", "n_medium", "compliance_confidence")


def k13_explanation(spark, sf_dir):
    return x.explanation(checked(spark, sf_dir))


def f02_token_sort_ratio(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "case_inputs").select("application_id", *[F.round(token_sort_ratio(F.lower(c("name")), F.lower(c(n))), 6).alias(n) for n in ("pan_card_name", "aadhaar_name", "slip_name")])


def f04_word_edits(spark, sf_dir):
    words = lambda name: F.filter(F.split(F.lower(name), " "), lambda w: w != "")
    rows = view(spark, sf_dir, "case_inputs").where("pan_card_name is not null and aadhaar_name is not null")
    return rows.select("application_id", edit_distance(words("name"), words("pan_card_name")).alias("pan_edits"), edit_distance(words("name"), words("aadhaar_name")).alias("aadhaar_edits"))


QUERIES = {
    f.__name__: f
    for f in (k01_kyc, k02_identity, k03_pan_key, k04_birth_date, k05_pmla, k06_fair_practices, k07_priority_sector, k08_rera, k11_rule_flags, k11_rule_status,
              k12_compliance_confidence, k13_explanation, f02_token_sort_ratio, f04_word_edits)
}

_METRO = "lower(trim(city)) IN ('mumbai', 'delhi', 'new delhi', 'bengaluru', 'bangalore', 'chennai', 'kolkata', 'hyderabad', 'pune', 'ahmedabad')"
_FORMATS = "['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y', '%d %b %Y', '%d %B %Y']"


def _born(column):
    return f"coalesce(strftime(try_strptime(trim({column}), {_FORMATS}), '%Y-%m-%d'), trim({column}))"


_SOURCES = (("pan card", "pan_card_name", 1), ("aadhaar", "aadhaar_name", 2), ("salary slip", "slip_name", 3), ("bank account", "bank_name", 4))
_WORDS = ", ".join(f"{sorted_words(f'lower({column})')} AS w{k}" for column, k in [("name", 0), *((c, k) for _, c, k in _SOURCES)])
_RATIO = "CASE WHEN w0 = w{0} THEN 100 ELSE 200.0::DOUBLE * {1} / (length(w0) + length(w{0})) END"


def ratio(k):
    return _RATIO.format(k, subsequence("w0", f"w{k}"))


def _missing(kind):
    return f"KYC_INCOMPLETE|CRITICAL|Required KYC document ''{kind}'' was not submitted."


def _bad(kind, why):
    return f"KYC_INCOMPLETE|CRITICAL|KYC document ''{kind}'' is {why}."


_NAMES = ", ".join(
    f"CASE WHEN coalesce(name, '') <> '' AND coalesce({column}, '') <> '' AND {ratio(k)} < 90 THEN concat('IDENTITY_MISMATCH_NAME|MEDIUM|Name on {source} (''', {column}, ''') does not match application form (''', name, ''').') END"
    for source, column, k in _SOURCES
)
_PROTECTED = ", ".join(f"CASE WHEN list_contains(used, '{p}') THEN 'PROTECTED_ATTRIBUTE_USED|CRITICAL|Protected attribute ''{p}'' was found in fields passed to decision logic, violating the RBI Fair Practices Code.' END" for p in x.PROTECTED)
#: case_inputs with the flags of all checks as code|severity|message, statuses and confidence.
COMPLIANCE_SQL = f"""SELECT *, len(list_filter(flags, lambda f: contains(f, '|CRITICAL|'))) AS n_critical, len(list_filter(flags, lambda f: contains(f, '|MEDIUM|') OR contains(f, '|HIGH|'))) AS n_medium,
 greatest(0.3::DOUBLE, {r("0.9::DOUBLE - 0.15::DOUBLE * len(list_filter(flags, lambda f: contains(f, '|CRITICAL|'))) - 0.05::DOUBLE * len(list_filter(flags, lambda f: contains(f, '|MEDIUM|') OR contains(f, '|HIGH|')))", 4)}) AS compliance_confidence,
 [replace(f, '|CRITICAL|', ': ') for f in flags if contains(f, '|CRITICAL|')] AS critical_flags,
 CASE WHEN list_contains([split_part(f, '|', 1) for f in flags], 'KYC_INCOMPLETE') THEN 'FAIL' ELSE 'PASS' END AS kyc_cdd,
 CASE WHEN len([f for f in flags if starts_with(f, 'IDENTITY_MISMATCH_PAN')]) > 0 THEN 'FAIL' WHEN len([f for f in flags if starts_with(f, 'IDENTITY')]) > 0 THEN 'WARNING' ELSE 'PASS' END AS identity_consistency,
 CASE WHEN NOT source_of_funds_declared THEN 'FAIL' WHEN NOT identity_verification_logged THEN 'WARNING' ELSE 'PASS' END AS pmla_source_of_funds,
 CASE WHEN len(protected_found) > 0 THEN 'FAIL' ELSE 'PASS' END AS rbi_fair_practices, 'PASS' AS nhb,
 CASE WHEN NOT under_construction THEN 'NOT_APPLICABLE' WHEN rera_status = 'REGISTERED' THEN 'PASS' ELSE 'FAIL' END AS rera FROM (
 SELECT *, list_filter([CASE WHEN NOT aadhaar_present THEN '{_missing("AADHAAR")}' WHEN NOT aadhaar_valid THEN '{_bad("AADHAAR", "not valid")}' END,
   CASE WHEN NOT address_present THEN '{_missing("ADDRESS_PROOF")}' WHEN NOT address_readable THEN '{_bad("ADDRESS_PROOF", "not readable")}' END,
   CASE WHEN NOT pan_present THEN '{_missing("PAN")}' WHEN NOT pan_doc_valid THEN '{_bad("PAN", "not valid")}' END, {_NAMES},
   CASE WHEN form_dob <> '' AND aadhaar_dob <> '' AND {_born("form_dob")} <> {_born("aadhaar_dob")} THEN concat('IDENTITY_MISMATCH_DOB|HIGH|DOB on Aadhaar (''', aadhaar_dob, ''') does not match application form (''', form_dob, ''').') END,
   CASE WHEN upper(replace(form_pan, ' ', '')) <> upper(replace(card_pan, ' ', '')) THEN 'IDENTITY_MISMATCH_PAN|CRITICAL|PAN number on application form does not match PAN card.' END,
   CASE WHEN NOT source_of_funds_declared THEN 'PMLA_SOURCE_OF_FUNDS_MISSING|CRITICAL|Source-of-funds declaration is missing or not logged.' END,
   CASE WHEN NOT identity_verification_logged THEN 'PMLA_IDENTITY_LOG_MISSING|MEDIUM|Identity verification was not logged prior to recommendation.' END, {_PROTECTED},
   CASE WHEN NOT priority_sector_eligible THEN concat('NHB_PRIORITY_SECTOR_MISCLASSIFIED|LOW|Loan amount ', CAST(CAST(loan_amount AS BIGINT) AS VARCHAR), '.0 exceeds the ', city_tier, ' priority-sector housing loan ceiling (', CASE city_tier WHEN 'metro' THEN '3500000' ELSE '2500000' END, ').') END,
   CASE WHEN under_construction AND rera_status <> 'REGISTERED' THEN 'RERA_NOT_REGISTERED|CRITICAL|Property is under construction but the builder/project is not RERA-registered; Property Valuation Agent output cannot be treated as reliable.' END
  ], lambda f: f IS NOT NULL) AS flags, [p for p in ['caste', 'gender', 'region', 'religion'] if list_contains(used, p)] AS protected_found FROM (
 SELECT *, string_split(lower(fields_used), ',') AS used, CASE WHEN coalesce(city, '') = '' THEN NULL WHEN {_METRO} THEN 'metro' ELSE 'non_metro' END AS city_tier,
  CASE WHEN coalesce(city, '') <> '' AND loan_amount IS NOT NULL THEN loan_amount <= CASE WHEN {_METRO} THEN 3500000 ELSE 2500000 END END AS priority_sector_eligible, {_WORDS} FROM case_inputs))"""


def _o(sql):
    return oracle(sql, "case_inputs", comp=COMPLIANCE_SQL)


_FLAGS = "SELECT application_id, generate_subscripts(flags, 1) - 1 AS place, unnest(flags) AS f FROM comp"


ORACLE = {
    "k01_kyc": _o("SELECT application_id, kyc_cdd AS kyc_status, concat_ws(',', CASE WHEN NOT (aadhaar_present AND aadhaar_valid) THEN 'AADHAAR' END, CASE WHEN NOT (address_present AND address_readable) THEN 'ADDRESS_PROOF' END, CASE WHEN NOT (pan_present AND pan_doc_valid) THEN 'PAN' END) AS missing_documents FROM comp"),
    "k02_identity": _o(f"SELECT application_id, split_part(f, '|', 1) AS code, split_part(f, '|', 2) AS severity, split_part(f, '|', 3) AS message FROM ({_FLAGS}) WHERE starts_with(f, 'IDENTITY')"),
    "k03_pan_key": oracle("SELECT application_id, upper(replace(pan_text, ' ', '')) AS pan FROM case_inputs", "case_inputs"),
    "k04_birth_date": oracle(f"SELECT application_id, {_born('aadhaar_dob')} AS born, {_born('dob_text')} AS stated FROM case_inputs", "case_inputs"),
    "k05_pmla": _o("SELECT application_id, pmla_source_of_funds AS pmla_status FROM comp"),
    "k06_fair_practices": _o("SELECT application_id, rbi_fair_practices AS status, array_to_string(protected_found, ',') AS protected_found FROM comp"),
    "k07_priority_sector": _o("SELECT application_id, city_tier, priority_sector_eligible, coalesce(NOT priority_sector_eligible, false) AS flagged FROM comp"),
    "k08_rera": _o("SELECT application_id, rera AS rera_check FROM comp"),
    "k11_rule_flags": _o(f"SELECT application_id, place, split_part(f, '|', 1) AS code, split_part(f, '|', 2) AS severity, split_part(f, '|', 3) AS message FROM ({_FLAGS})"),
    "k11_rule_status": _o(f"SELECT application_id, {', '.join(x.CHECKS)} FROM comp"),
    "k12_compliance_confidence": _o("SELECT application_id, n_critical, n_medium, compliance_confidence FROM comp"),
    "k13_explanation": _o("SELECT application_id, CASE WHEN len(critical_flags) > 0 THEN concat('Compliance review identified critical issue(s) requiring human review: ', array_to_string(critical_flags, '; '), '.') ELSE 'All compliance checks passed; no critical issues identified.' END AS explanation FROM comp"),
    "f02_token_sort_ratio": oracle("SELECT application_id, " + ", ".join(f"round({ratio(k)}, 6) AS {column}" for _, column, k in _SOURCES[:3]) + f" FROM (SELECT *, {_WORDS} FROM case_inputs)", "case_inputs"),
    "f04_word_edits": oracle(
        f"SELECT application_id, {edits('wn', 'wp')} AS pan_edits, {edits('wn', 'wa')} AS aadhaar_edits FROM (SELECT application_id, " + ", ".join(f"[w for w in string_split(lower({c}), ' ') if w <> ''] AS {n}" for c, n in (("name", "wn"), ("pan_card_name", "wp"), ("aadhaar_name", "wa"))) + " FROM case_inputs WHERE pan_card_name IS NOT NULL AND aadhaar_name IS NOT NULL)",
        "case_inputs",
    ),
}
