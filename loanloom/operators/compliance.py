"""Compliance checks over tables of applications: one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.config import COMPLIANCE
from loanloom.functions.columns import dated, present, rounded
from loanloom.functions.names import token_sort_reaches

#: Cities of the metro ceiling, attributes that no decision may use, the documents a file needs
#: and the date formats accepted.
METRO = ("mumbai", "delhi", "new delhi", "bengaluru", "bangalore", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad")
PROTECTED = ("caste", "gender", "region", "religion")
REQUIRED = ("AADHAAR", "ADDRESS_PROOF", "PAN")
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy")
CHECKS = ("kyc_cdd", "identity_consistency", "pmla_source_of_funds", "rbi_fair_practices", "nhb", "rera")


def pan_key(x: Column) -> Column:
    """A PAN without white space, in capitals."""
    return F.upper(F.regexp_replace(x, r"\s+", ""))


def birth_date(text: Column) -> Column:
    """The ISO date of a text in one of DATE_FORMATS; any other text stays as it is, trimmed."""
    clean = F.trim(text)
    return F.coalesce(*[dated(clean, f).cast("string") for f in DATE_FORMATS], clean)


def city_tier(city: Column) -> Column:
    """metro or non_metro; null without a city. Other white space than none is a city of its own."""
    return F.when(F.coalesce(city, F.lit("")) == "", None).when(F.lower(F.trim(city)).isin(*METRO), "metro").otherwise("non_metro")


def names_match(a: Column, b: Column, threshold: float = COMPLIANCE["name_threshold"]) -> Column:
    """Whether two names are alike; a missing one is no mismatch."""
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, True).otherwise(token_sort_reaches(F.lower(a), F.lower(b), threshold))


def _flag(code: str, severity: str, check: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(check).alias("check"), text.alias("message"))


def _held(*pairs: tuple[Column, Column]) -> Column:
    """The flags whose condition holds, in order."""
    return F.filter(F.array(*[F.when(condition, flag) for condition, flag in pairs]), lambda x: x.isNotNull())


def identity_flags(c) -> Column:
    """Names of four sources against the form's, dates of birth and PANs; what is missing doesn't differ."""
    names = [("pan card", "pan_card_name"), ("aadhaar", "aadhaar_name"), ("salary slip", "slip_name"), ("bank account", "bank_name")]
    differ = [
        (~names_match(c("name"), c(column)), _flag("IDENTITY_MISMATCH_NAME", "MEDIUM", "identity_consistency",
         F.concat(F.lit(f"Name on {source} ('"), c(column), F.lit("') does not match application form ('"), c("name"), F.lit("')."))))
        for source, column in names
    ]
    there = lambda *x: F.forall(F.array(*[c(n) for n in x]), lambda v: F.coalesce(v, F.lit("")) != "")
    born = there("form_dob", "aadhaar_dob") & (birth_date(c("form_dob")) != birth_date(c("aadhaar_dob")))
    message = F.concat(F.lit("DOB on Aadhaar ('"), c("aadhaar_dob"), F.lit("') does not match application form ('"), c("form_dob"), F.lit("')."))
    pan = there("form_pan", "card_pan") & (pan_key(c("form_pan")) != pan_key(c("card_pan")))
    return _held(*differ, (born, _flag("IDENTITY_MISMATCH_DOB", "HIGH", "identity_consistency", message)),
        (pan, _flag("IDENTITY_MISMATCH_PAN", "CRITICAL", "identity_consistency", "PAN number on application form does not match PAN card.")))


def kyc_flags(c) -> Column:
    """Missing, invalid and unreadable documents of REQUIRED, in that order."""
    missing = lambda kind: _flag("KYC_INCOMPLETE", "CRITICAL", "kyc_cdd", f"Required KYC document '{kind}' was not submitted.")
    bad = lambda kind, why: _flag("KYC_INCOMPLETE", "CRITICAL", "kyc_cdd", f"KYC document '{kind}' is {why}.")
    return _held(
        (~c("aadhaar_present"), missing("AADHAAR")), (c("aadhaar_present") & ~c("aadhaar_valid"), bad("AADHAAR", "not valid")),
        (~c("address_present"), missing("ADDRESS_PROOF")), (c("address_present") & ~c("address_readable"), bad("ADDRESS_PROOF", "not readable")),
        (~c("pan_present"), missing("PAN")), (c("pan_present") & ~c("pan_doc_valid"), bad("PAN", "not valid")),
    )


def _about(kind: str):
    return lambda x: F.contains(x["message"], F.lit(f"'{kind}'"))


def amount_text(x: Column) -> Column:
    """A money amount as the messages write it: with one decimal place at least."""
    return F.regexp_replace(F.format_string("%.2f", x), "0$", "")


def checked(cases: DataFrame) -> DataFrame:
    """cases with the flags of all checks (code, severity, check, message), the status of each check, what the
    checks found, and the confidence in the assessment."""
    c = F.col
    tier = city_tier(c("city"))
    ceiling = F.when(tier == "metro", COMPLIANCE["metro_ceiling"]).otherwise(COMPLIANCE["non_metro_ceiling"])
    eligible = F.when(c("loan_amount").isNull() | tier.isNull(), None).otherwise(c("loan_amount") <= ceiling)
    used = F.array_intersect(F.array(*[F.lit(x) for x in PROTECTED]), F.split(F.lower(c("fields_used")), ","))
    df = cases.withColumns({
        "city_tier": tier, "priority_sector_eligible": eligible,
        "protected_found": F.coalesce(used, F.array().cast("array<string>")),
        "kyc_flags": kyc_flags(c), "identity_flags": identity_flags(c),
        "pmla_flags": _held(
            (~F.coalesce(c("source_of_funds_declared"), F.lit(False)), _flag("PMLA_SOURCE_OF_FUNDS_MISSING", "CRITICAL", "pmla_source_of_funds", "Source-of-funds declaration is missing or not logged.")),
            (~F.coalesce(c("identity_verification_logged"), F.lit(False)), _flag("PMLA_IDENTITY_LOG_MISSING", "MEDIUM", "pmla_source_of_funds", "Identity verification was not logged prior to recommendation."))),
        "nhb_flags": _held((~eligible, _flag("NHB_PRIORITY_SECTOR_MISCLASSIFIED", "LOW", "nhb",
            F.concat(F.lit("Loan amount "), amount_text(c("loan_amount")), F.lit(" exceeds the "), tier, F.lit(" priority-sector housing loan ceiling ("), ceiling.cast("long").cast("string"), F.lit(").")) ))),
        "rera_flags": _held((F.coalesce(c("under_construction"), F.lit(False)) & (F.coalesce(c("rera_status"), F.lit("unknown")) != "REGISTERED"), _flag("RERA_NOT_REGISTERED", "CRITICAL", "rera",
            "Property is under construction but the builder/project is not RERA-registered; Property Valuation Agent output cannot be treated as reliable."))),
    })
    used_flags = F.transform("protected_found", lambda x: F.struct(F.lit("PROTECTED_ATTRIBUTE_USED").alias("code"), F.lit("CRITICAL").alias("severity"), F.lit("rbi_fair_practices").alias("check"),
        F.concat(F.lit("Protected attribute '"), x, F.lit("' was found in fields passed to decision logic, violating the RBI Fair Practices Code.")).alias("message")))
    df = df.withColumn("flags", F.concat("kyc_flags", "identity_flags", "pmla_flags", used_flags, "nhb_flags", "rera_flags"))
    of = lambda *severities: F.size(F.filter("flags", lambda x: x["severity"].isin(*severities)))
    critical = lambda column: F.exists(column, lambda x: x["severity"] == "CRITICAL")
    level = lambda column: F.when(critical(column), "FAIL").when(F.size(column) > 0, "WARNING").otherwise("PASS")
    df = df.withColumns({
        "n_critical": of("CRITICAL"), "n_medium": of("MEDIUM", "HIGH"),
        "kyc_cdd": F.when(F.size("kyc_flags") > 0, "FAIL").otherwise("PASS"),
        "missing_documents": present(*[(F.exists("kyc_flags", _about(kind)), kind) for kind in REQUIRED]),
        "identity_consistency": level("identity_flags"), "pmla_source_of_funds": level("pmla_flags"),
        "rbi_fair_practices": F.when(F.size("protected_found") > 0, "FAIL").otherwise("PASS"), "nhb": F.lit("PASS"),
        "rera": F.when(~F.coalesce(c("under_construction"), F.lit(False)), "NOT_APPLICABLE").when(c("rera_status") == "REGISTERED", "PASS").otherwise("FAIL"),
        "critical_flags": F.transform(F.filter("flags", lambda x: x["severity"] == "CRITICAL"), lambda x: F.concat(x["code"], F.lit(": "), x["message"])),
    })
    confidence = COMPLIANCE["base"] - COMPLIANCE["per_critical"] * c("n_critical") - COMPLIANCE["per_other"] * c("n_medium")
    df = df.withColumn("compliance_confidence", F.greatest(F.lit(COMPLIANCE["floor"]), rounded(confidence, 4)))
    return df.drop("kyc_flags", "identity_flags", "pmla_flags", "nhb_flags", "rera_flags")


def rule_status(found: DataFrame) -> DataFrame:
    """application_id and the status of each check as a map."""
    pairs = [x for name in CHECKS for x in (F.lit(name), F.col(name))]
    return found.select("application_id", F.create_map(*pairs).alias("rule_status"))


def flag_table(found: DataFrame) -> DataFrame:
    """One row per flag: application_id, its place, check, code, severity and message."""
    # of posexplode() the optimizer infers a filter on the flags, which would work them out once more
    rows = found.select("application_id", F.posexplode_outer("flags").alias("place", "x")).where("x is not null")
    return rows.select("application_id", "place", "x.check", "x.code", "x.severity", "x.message")


def explanation(found: DataFrame) -> DataFrame:
    """application_id and a sentence on the critical flags."""
    listed = F.concat(F.lit("Compliance review identified critical issue(s) requiring human review: "), F.concat_ws("; ", "critical_flags"), F.lit("."))
    return found.select("application_id", F.when(F.size("critical_flags") > 0, listed).otherwise("All compliance checks passed; no critical issues identified.").alias("explanation"))
