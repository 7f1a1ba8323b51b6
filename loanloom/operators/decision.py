"""The gated decision over whole portfolios: one join of cases and credit assessments, then projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.config import DECISION, RISK_WEIGHTS
from loanloom.functions.columns import clamp, present, rounded
from loanloom.operators import compliance

#: What a decision needs of each application.
REQUIRED = ("borrower_profile", "document_analysis", "credit_analysis", "property_analysis", "compliance_analysis")
#: Words by which a factor counts for or against an application, the former first.
POSITIVE = ("excellent", "good", "stable", "high conf", "present", "verified", "registered")
NEGATIVE = ("poor", "high foir", "high ltv", "missing", "low", "unstable", "variance", "not registered", "no cibil")


def difference_percent(a: Column, b: Column) -> Column:
    """100 * |a - b| / max(|a|, |b|); 0 where either is missing or both are 0."""
    return F.coalesce(F.try_divide(F.abs(a - b) * 100.0, F.greatest(F.abs(a), F.abs(b))), F.lit(0.0))


#: Pairs of values that stages should agree on: name, columns, tolerance and bound of HIGH, in percent.
PAIRS = (
    ("income:document-credit", "doc_monthly_income", "monthly_income", DECISION["income_tolerance"], 30.0),
    ("income:profile-credit", "profile_income", "monthly_income", DECISION["income_tolerance"], 30.0),
    ("value:valuation-profile", "estimated_value", "property_value", DECISION["value_tolerance"], 20.0),
    ("value:valuation-credit", "estimated_value", "property_value", DECISION["value_tolerance"], 20.0),
    ("score:declared-credit", "declared_cibil", "cibil_score", 5.0, 5.0),
)


def _contradictions() -> Column:
    """Of a joined row: field, difference, severity and resolution of each contradiction; what the documents
    report comes last, without a difference."""
    items = []
    for name, a, b, tolerance, high in PAIRS:
        d = difference_percent(F.col(a), F.col(b))
        severity = F.when(d > high, "HIGH").otherwise("MEDIUM")
        items.append(F.when(d > tolerance, F.struct(F.lit(name).alias("field"), rounded(d, 4).alias("difference"), severity.alias("severity"), F.lit("UNRESOLVED").alias("resolution"))))
    reported = F.struct(F.lit("reported").alias("field"), F.lit(None).cast("double").alias("difference"), F.col("reported_severity").alias("severity"), F.coalesce("reported_resolution", F.lit("UNRESOLVED")).alias("resolution"))
    items.append(F.when(F.col("reported_severity").isNotNull(), reported))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def contradictions(joined: DataFrame) -> DataFrame:
    """One row per contradiction between the stages' values: field, difference, severity and resolution."""
    return joined.select("application_id", F.inline(_contradictions()))


_CASE = ("n_missing_documents", "extraction_confidence", "verification_status", "n_provenance", "doc_monthly_income", "reported_severity", "reported_resolution")
_PROPERTY = ("estimated_value", "valuation_confidence", "valuation_variance_percent", "rera_status")


def joined_cases(assessed: DataFrame, cases: DataFrame) -> DataFrame:
    """All applications of either side; missing where one lacks its id, its credit assessment, its case inputs
    or one of their parts. missing_fields lists what is missing."""
    c = F.col
    found = compliance.checked(cases)
    own = found.select("application_id", c("monthly_income").alias("profile_income"), "name", "declared_cibil", c("loan_amount").alias("profile_loan"), "n_critical", "n_medium", "critical_flags", "compliance_confidence", *compliance.CHECKS,
        *[F.when(c("has_documents"), c(x)).alias(x) for x in _CASE], *[F.when(c("has_property"), c(x)).alias(x) for x in _PROPERTY], "has_documents", "has_property", F.lit(True).alias("has_case"))
    credit = assessed.select("application_id", "monthly_income", "loan_amount", "loan_tenure_months", "employment_type", "property_value", "cibil_score", "credit_band", "risk_tier", "foir", "ltv", "obligations", "income_stability", "credit_confidence", "flags", "preliminary_decision", F.lit(True).alias("has_credit"))
    df = credit.join(own, "application_id", "full")
    has = lambda name: F.coalesce(c(name), F.lit(False))
    lacking = present(
        (F.coalesce(c("application_id").cast("string"), F.lit("")) == "", "application_id"),
        (~has("has_case"), "borrower_profile"), (~has("has_documents"), "document_analysis"), (~has("has_credit"), "credit_analysis"),
        (~has("has_property"), "property_analysis"), (~has("has_case"), "compliance_analysis"),
    )
    return df.withColumn("missing_fields", lacking).withColumn("missing", F.size("missing_fields") > 0)


def validated(joined: DataFrame) -> DataFrame:
    """application_id, whether its inputs are complete, the missing ones, warnings and the status of each input."""
    c = F.col
    there = lambda name: ~F.array_contains("missing_fields", name)
    n = F.coalesce("n_missing_documents", F.lit(0))
    borrower = there("borrower_profile")
    warnings = present(
        (borrower & (F.coalesce("name", F.lit("")) == ""), "borrower_profile.name is empty"),
        (borrower & (F.coalesce("profile_income", F.lit(0.0)) <= 0), "borrower_profile.monthly_income is not positive"),
        (borrower & (F.coalesce("profile_loan", F.lit(0.0)) <= 0), "borrower_profile.loan_amount is not positive"),
        (there("document_analysis") & (n > 0), "Missing documents"),
        (there("document_analysis") & (n > 3), "Many documents missing — income/asset verification may be unreliable"),
        (there("credit_analysis") & (F.coalesce("cibil_score", F.lit(300)) < 300), "CIBIL score below expected range — possible data error"),
        (there("compliance_analysis") & (F.coalesce("n_critical", F.lit(0)) > 0), "Compliance critical flags present"),
    )
    status = F.create_map(*[x for name in REQUIRED for x in (F.lit(name), F.when(there(name), "PRESENT").otherwise("MISSING"))])
    return joined.select("application_id", (~c("missing")).alias("is_complete"), "missing_fields", warnings.alias("warnings"), status.alias("upstream_status"))


def _percent(x: Column) -> Column:
    return F.format_string("%.0f%%", rounded(x * 100, 0))


def _stepped(x: Column, name: str) -> tuple[Column, Column]:
    """Points and factor of a ratio: the lower, the better."""
    bounds = {"FOIR": (0.30, 0.40, 0.50, 0.60), "LTV": (0.60, 0.70, 0.80, 0.90)}[name]
    points, words = F.when(x.isNull(), 50.0), F.when(x.isNull(), F.lit({"FOIR": "FOIR not available", "LTV": "LTV not calculable"}[name]))
    for bound, value, word in zip(bounds, (95.0, 80.0, 60.0, 35.0), ("Excellent", "Good", "Moderate", "High"), strict=True):
        points, words = points.when(x <= bound, value), words.when(x <= bound, F.concat(F.lit(f"{word} {name} ("), _percent(x), F.lit(")")))
    return points.otherwise(15.0), words.otherwise(F.concat(F.lit(f"Very high {name} ("), _percent(x), F.lit(")")))


def components() -> dict[str, tuple[Column, Column]]:
    """Of a joined row: points (0 to 100) and factors of each risk component."""
    c = F.col
    score = c("cibil_score")
    level = lambda *values: F.when(score.isNull(), values[0]).when(score >= 750, values[1]).when(score >= 700, values[2]).when(score >= 650, values[3]).when(score >= 550, values[4]).otherwise(values[5])
    word = level(*map(F.lit, ("No CIBIL score available", "Excellent", "Good", "Fair", "Below-average", "Poor")))
    word = F.when(score.isNull(), word).otherwise(F.concat(word, F.lit(" CIBIL score ("), score.cast("string"), F.lit(")")))
    tier = F.when(c("risk_tier") == "low", "Low credit risk tier").when(c("risk_tier") == "high", "High credit risk tier")
    credit = clamp(50.0 + level(-20, 30, 20, 5, -10, -30) + F.when(c("risk_tier") == "low", 10).when(c("risk_tier") == "high", -15).otherwise(0), 0.0, 100.0)
    v = F.coalesce("valuation_confidence", F.lit(0.0))
    of_value = lambda *x: F.when(v >= 0.8, x[0]).when(v >= 0.6, x[1]).when(v >= 0.4, x[2]).otherwise(x[3])
    place = of_value(90.0, 70.0, 45.0, 20.0)
    place = F.when(c("rera_status") == "registered", F.least(F.lit(100.0), place + 10)).when(c("rera_status") == "not_registered", place - 10).otherwise(place)
    variance = F.coalesce("valuation_variance_percent", F.lit(0.0))
    place_factors = (
        F.concat(of_value(*map(F.lit, ("High", "Moderate", "Low", "Very low"))), F.lit(" valuation confidence ("), _percent(v), F.lit(")")),
        F.when(c("rera_status") == "registered", "RERA registered property").when(c("rera_status") == "not_registered", "Property not RERA registered"),
        F.when(F.abs(variance) > 20, F.format_string("High valuation variance (%.1f%%)", rounded(variance, 1))),
    )
    missing, extraction = F.coalesce("n_missing_documents", F.lit(0)), F.coalesce("extraction_confidence", F.lit(0.0))
    papers = F.when(missing == 0, 85.0).when(missing <= 2, 60.0).otherwise(30.0)
    papers = papers + F.when(extraction >= 0.8, 10.0).when(extraction < 0.5, -10.0).otherwise(0.0)
    papers = F.least(F.lit(100.0), papers) + F.when(c("verification_status") == "verified", 5.0).otherwise(0.0)
    paper_factors = (
        F.when(missing == 0, F.lit("All required documents present")).when(missing <= 2, F.concat(missing.cast("string"), F.lit(" document(s) missing"))).otherwise(F.concat(missing.cast("string"), F.lit(" documents missing"))),
        F.when(extraction >= 0.8, "High extraction confidence").when(extraction < 0.5, "Low extraction confidence"),
        F.when(c("verification_status") == "verified", "Documents verified"),
    )
    stable = lambda *x: F.when(c("income_stability") == "stable", x[0]).when(c("income_stability") == "moderately_stable", x[1]).when(c("income_stability") == "unstable", x[2]).otherwise(x[3])
    foir, ltv = _stepped(c("foir"), "FOIR"), _stepped(F.coalesce(c("ltv"), F.when(c("property_value") > 0, c("loan_amount") / c("property_value"))), "LTV")
    given = lambda *x: F.filter(F.array(*x), lambda y: y.isNotNull())
    return {
        "credit": (credit, given(word, tier)),
        "foir": (foir[0], given(foir[1])),
        "ltv": (ltv[0], given(ltv[1])),
        "property": (F.greatest(F.lit(0.0), place - F.when(F.abs(variance) > 20, 15.0).otherwise(0.0)), given(*place_factors)),
        "documents": (F.least(F.lit(100.0), papers), given(*paper_factors)),
        "stability": (stable(90.0, 70.0, 35.0, 50.0), given(stable(*map(F.lit, ("Stable income history", "Moderately stable income", "Unstable income", "Income stability unknown"))))),
    }


def _about(words: tuple[str, ...]):
    return lambda x: F.array_contains(F.array(*[F.contains(F.lower(x), F.lit(w)) for w in words]), True)


def _risks(df: DataFrame) -> DataFrame:
    """Components, their factors, the score and whether it could be computed."""
    c = F.col
    parts = components()
    df = df.withColumns({f"part_{name}": points for name, (points, _) in parts.items()} | {f"factors_{name}": factors for name, (_, factors) in parts.items()})
    total = sum((c(f"part_{name}") * weight for name, weight in RISK_WEIGHTS.items()), F.lit(0.0))
    failed = F.col("has_property") & (c("valuation_confidence").isNull() | c("valuation_variance_percent").isNull()) | F.col("has_documents") & c("extraction_confidence").isNull()
    df = df.withColumns({"risk_failed": F.coalesce(failed, F.lit(False)), "factors": F.concat(*[f"factors_{name}" for name in parts])})
    good = F.filter("factors", _about(POSITIVE))
    bad = F.filter("factors", lambda x: ~_about(POSITIVE)(x) & _about(NEGATIVE)(x))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "decision_score": F.when(c("risk_failed"), 0.0).otherwise(rounded(total, 1)),
        "positive_factors": F.when(c("risk_failed"), none).otherwise(good),
        "risk_factors": F.when(c("risk_failed"), F.array(F.lit("Risk calculation failure"))).otherwise(bad),
    }).drop(*[f"factors_{name}" for name in parts], "factors")


def _trust(df: DataFrame) -> DataFrame:
    """The confidence in the decision from completeness, stages, provenance and what speaks against it."""
    c = F.col
    serious = lambda x: x["severity"].isin("HIGH", "CRITICAL")
    apart = lambda a, b: F.coalesce((c(a) != 0) & (c(b) != 0) & (F.abs(c(a) - c(b)) / F.greatest(c(a), F.lit(1.0)) >= 0.1), F.lit(False))
    df = df.withColumn("contradictions", _contradictions())
    stated = F.filter(F.array("credit_confidence", "valuation_confidence", "compliance_confidence", "extraction_confidence"), lambda x: x > 0)
    mean = F.try_divide(F.aggregate(stated, F.lit(0.0), lambda a, x: a + x), F.size(stated))
    lacking = F.size(F.array_except("missing_fields", F.array(F.lit("application_id"))))
    df = df.withColumns({
        "completeness": (len(REQUIRED) - lacking) / len(REQUIRED),
        "n_high": F.size(F.filter("contradictions", serious)),
        "n_unresolved": F.size(F.filter("contradictions", lambda x: serious(x) & (x["resolution"] == "UNRESOLVED"))),
        "material": apart("doc_monthly_income", "monthly_income") | apart("estimated_value", "property_value"),
        "mean_stated": F.coalesce(mean, F.lit(0.0)), "n_critical": F.coalesce("n_critical", F.lit(0)),
    })
    confidence = (
        0.50 + 0.25 * c("completeness") + 0.15 * c("mean_stated") + 0.20 * F.least(F.coalesce("n_provenance", F.lit(0)) / 10.0, F.lit(1.0))
        - 0.10 * c("n_high") - F.when(c("material"), 0.10).otherwise(0.0) - F.least(0.05 * c("n_critical"), F.lit(0.15))
    )
    return df.withColumn("stated_confidence", rounded(clamp(confidence, 0.0, 1.0), 4))


def evaluated(assessed: DataFrame, cases: DataFrame) -> DataFrame:
    """Every application with its risk components, factors, contradictions and confidence, complete or not."""
    return _trust(_risks(joined_cases(assessed, cases)))


def finalised(df: DataFrame, disagree: Column | None = None) -> DataFrame:
    """The gate and decision of evaluated rows; with missing inputs nothing is assessed: score and confidence
    are 0, the components null, and the application is suspended. disagree: whether the roles disagree."""
    c = F.col
    unknown = {x: F.when(~c("missing"), c(x)) for x in (*(f"part_{name}" for name in RISK_WEIGHTS), "n_high", "material", "mean_stated", "positive_factors")}
    lacking = F.array(F.concat(F.lit("Missing required inputs: "), F.concat_ws(", ", "missing_fields")))
    df = df.withColumns(unknown | {
        "decision_score": F.when(c("missing"), 0.0).otherwise(c("decision_score")),
        "confidence": F.when(c("missing"), 0.0).otherwise(c("stated_confidence")),
        "risk_factors": F.when(c("missing"), lacking).otherwise(c("risk_factors")),
    })
    gates = (
        (c("missing"), "missing_inputs", None), (c("n_critical") > 0, "critical_compliance", "Critical compliance flag"), (c("n_unresolved") > 0, "contradiction", "Unresolved critical contradiction"),
        (c("confidence") < DECISION["confidence"], "low_confidence", "Low confidence"), (F.lit(False) if disagree is None else disagree, "crew_disagreement", "Material crew disagreement"),
        (c("risk_failed"), "risk_failure", None),
    )
    gate, because = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, factor in reversed(gates):
        gate, because = F.when(holds, name).otherwise(gate), F.when(holds, factor).otherwise(because)
    df = df.withColumn("gate", gate).withColumn("risk_factors", F.concat("risk_factors", F.filter(F.array(because), lambda x: x.isNotNull())))
    decision = F.when(c("gate").isNotNull(), "SUSPEND").when(c("decision_score") >= DECISION["approve"], "APPROVE").when(c("decision_score") <= DECISION["deny"], "DENY").otherwise("SUSPEND")
    level = F.when(c("decision_score") >= 80, "LOW").when(c("decision_score") >= 60, "MODERATE").when(c("decision_score") >= 40, "HIGH").otherwise("VERY_HIGH")
    df = df.withColumns({"risk_level": level, "decision": decision, "human_review": decision != "APPROVE"})
    score = F.format_string("%.1f", c("decision_score"))
    why = (
        F.when(c("gate") == "missing_inputs", F.concat(F.lit("Required inputs missing: "), F.concat_ws(", ", "missing_fields")))
        .when(c("gate") == "critical_compliance", "Critical compliance flag present → SUSPEND")
        .when(c("gate") == "contradiction", "Unresolved critical contradiction → SUSPEND")
        .when(c("gate") == "low_confidence", F.concat(F.format_string("Confidence %.3f", rounded(c("confidence"), 3)), F.lit(f" < threshold {DECISION['confidence']} → SUSPEND")))
        .when(c("gate") == "crew_disagreement", "Material crew disagreement → SUSPEND")
        .when(c("gate") == "risk_failure", "Required risk calculation failed → SUSPEND")
        .when(c("decision") == "APPROVE", F.concat(F.lit("Risk score "), score, F.lit(" >= approval threshold 80 → APPROVE")))
        .when(c("decision") == "DENY", F.concat(F.lit("Risk score "), score, F.lit(" <= denial threshold 40 → DENY")))
        .otherwise(F.concat(F.lit("Risk score "), score, F.lit(" in review zone (40-80) → SUSPEND")))
    )
    status = F.when(c("gate") == "critical_compliance", "BLOCKED").when(c("gate").isNull() & (c("decision") != "SUSPEND"), "PASS")
    return df.withColumns({"rationale": why, "compliance_status": status})


def decided(assessed: DataFrame, cases: DataFrame) -> DataFrame:
    """Risk components and score, confidence, gate and decision of each application, without roles."""
    return finalised(evaluated(assessed, cases))


def recommended(df: DataFrame) -> DataFrame:
    """Evaluated rows with what underwriter, risk analyst and report writer recommend and how sure they are. The
    analyst never denies: low scores are suspended first. Incomplete applications get no recommendation."""
    c = F.col
    critical, score, sure = c("n_critical") > 0, c("decision_score"), c("stated_confidence")
    firm = sure >= DECISION["confidence"]
    unresolved = F.exists("contradictions", lambda x: (x["severity"] == "CRITICAL") & (x["resolution"] == "UNRESOLVED"))
    main = F.when(critical, "SUSPEND").when((score >= 80) & firm, "APPROVE").when((score <= 40) & firm, "DENY").otherwise("SUSPEND")
    main_sure = lambda rest: F.when(critical, 0.95).when((score >= 80) & firm, 0.9).when((score <= 40) & firm, DECISION["confidence"]).otherwise(rest)
    careful = critical | unresolved | (score < 50) | (sure < 0.8)
    analyst = F.when(careful, "SUSPEND").when((score >= 85) & (sure >= 0.9), "APPROVE").otherwise("SUSPEND")
    analyst_sure = F.when(careful, 0.9).when((score >= 85) & (sure >= 0.9), 0.85).otherwise(0.75)
    number, trust = F.format_string("%.1f", score), F.format_string("%.2f", rounded(sure, 2))
    flags = F.size("flags") > 0
    said = lambda *parts: F.concat_ws(" ", *parts)
    underwriter_says = said(
        F.when(critical, F.lit("Critical compliance flag triggers mandatory suspend.")).when(score >= 80, F.concat(F.lit("Strong risk score ("), number, F.lit("/100) supports approval.")))
        .when(score <= 40, F.concat(F.lit("Weak risk score ("), number, F.lit("/100) warrants denial."))).otherwise(F.concat(F.lit("Risk score ("), number, F.lit("/100) falls in review zone."))),
        F.when(flags, F.concat(F.lit("Credit flags present: "), F.concat_ws(", ", "flags"), F.lit("."))),
    )
    analyst_says = said(
        F.lit("Independent risk assessment:"), F.when(unresolved, "Unresolved critical contradiction requires suspension."), F.when(critical, "Critical compliance issue blocks approval."),
        F.when(score < 50, F.concat(F.lit("Risk score ("), number, F.lit(") below comfort threshold."))), F.when(sure < 0.8, F.concat(F.lit("Confidence ("), trust, F.lit(") insufficient for decisive action."))),
        F.when(flags, F.concat(F.lit("Credit flags ("), F.size("flags").cast("string"), F.lit(") elevate risk profile."))),
    )
    complete = ~c("missing")
    roles = {"underwriter": main, "analyst": analyst, "report_writer": main, "underwriter_confidence": main_sure(0.7), "analyst_confidence": analyst_sure, "report_writer_confidence": main_sure(0.8),
             "underwriter_reasoning": underwriter_says, "analyst_reasoning": analyst_says}
    df = df.withColumns({name: F.when(complete, value) for name, value in roles.items()})
    return df.withColumn("roles_disagree", F.coalesce(c("underwriter") != c("analyst"), F.lit(False)))


def full_stage(assessed: DataFrame, cases: DataFrame) -> DataFrame:
    """The decision with roles: their disagreement is one more gate, so low scores are suspended, never denied."""
    return finalised(recommended(evaluated(assessed, cases)), F.col("roles_disagree"))


def report(staged: DataFrame) -> DataFrame:
    """application_id and the sections of its underwriting report as JSON."""
    c = F.col
    some = lambda *names: F.struct(*[c(n) for n in names])
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), c(f"part_{n}").alias("raw_score"), rounded(c(f"part_{n}") * w, 4).alias("weighted_score")) for n, w in RISK_WEIGHTS.items()])
    crew = F.when(c("underwriter").isNotNull(), F.concat(F.lit(" | Crew: Underwriter: "), c("underwriter_reasoning"), F.lit(" | Risk Analyst: "), c("analyst_reasoning")))
    sections = F.struct(
        some("application_id", "decision").alias("application_summary"),
        F.struct(F.coalesce("name", F.lit("N/A")).alias("name"), F.coalesce("profile_income", F.lit(0.0)).alias("monthly_income"), F.coalesce("employment_type", F.lit("N/A")).alias("employment_type"), F.coalesce("profile_loan", F.lit(0.0)).alias("loan_amount"), F.coalesce("loan_tenure_months", F.lit(0)).alias("loan_tenure_months"), F.coalesce("property_value", F.lit(0.0)).alias("property_value")).alias("borrower_summary"),
        F.struct(F.coalesce("verification_status", F.lit("unknown")).alias("status"), F.coalesce("n_missing_documents", F.lit(0)).alias("missing_documents"), F.coalesce("extraction_confidence", F.lit(0.0)).alias("extraction_confidence")).alias("document_verification"),
        some("cibil_score", "risk_tier", "obligations", "income_stability", "flags").alias("credit_assessment"),
        some("foir", "ltv").alias("foir_ltv"),
        F.struct(F.coalesce("estimated_value", F.lit(0.0)).alias("estimated_value"), F.coalesce("valuation_confidence", F.lit(0.0)).alias("valuation_confidence"), F.coalesce("rera_status", F.lit("N/A")).alias("rera_status")).alias("property_valuation"),
        some("kyc_cdd", "pmla_source_of_funds", "rbi_fair_practices", "critical_flags", "compliance_confidence").alias("compliance"),
        F.struct(c("decision_score").alias("score"), c("risk_level").alias("level"), parts.alias("components")).alias("risk_score_section"),
        F.struct(c("confidence").alias("score"), (c("confidence") < DECISION["confidence"]).alias("below_threshold"), c("completeness").alias("completeness")).alias("confidence_section"),
        F.coalesce("positive_factors", F.array().cast("array<string>")).alias("positive_factors"), c("risk_factors").alias("risk_factors"),
        F.concat(c("rationale"), F.coalesce(crew, F.lit(""))).alias("final_recommendation"),
        F.when(c("human_review"), "REQUIRED").otherwise("NOT_REQUIRED").alias("human_review_status"),
    )
    return staged.select("application_id", F.to_json(sections).alias("report"))


def _money(x: Column) -> Column:
    """Rupees in crore, lakh or whole."""
    return F.when(x >= 1e7, F.format_string("₹%.2f Cr", rounded(x / 1e7, 2))).when(x >= 1e5, F.format_string("₹%.2f L", rounded(x / 1e5, 2))).otherwise(F.format_string("₹%,.0f", rounded(x, 0)))


def stages(staged: DataFrame) -> DataFrame:
    """Five rows per application: stage, its place, confidence, status and subtitle."""
    c = F.col
    text = lambda x: F.coalesce(x.cast("string"), F.lit("—"))
    valued = F.coalesce(c("estimated_value") > 0, F.lit(False))
    flagged = lambda bad: F.when(bad, "Flagged").otherwise("Complete")
    critical = c("n_critical") > 0
    rows = [
        ("Document Ingestion", c("extraction_confidence"), flagged((F.coalesce("n_missing_documents", F.lit(0)) > 0) | c("reported_severity").isNotNull()), F.concat(F.lit("Verification: "), F.coalesce("verification_status", F.lit("unknown")))),
        ("Credit Analysis", c("credit_confidence"), flagged(c("credit_confidence").isNull()), F.concat(F.lit("CIBIL "), text(c("cibil_score")), F.lit(" · "), text(c("credit_band")))),
        ("Property Valuation", c("valuation_confidence"), flagged(~valued), F.when(valued, F.concat(F.lit("Estimated "), _money(c("estimated_value")))).otherwise("No valuation available")),
        ("Compliance", c("compliance_confidence"), F.when(critical, "Hard gate").otherwise("Complete"), F.when(critical, F.concat(c("n_critical").cast("string"), F.lit(" critical flag(s)"))).otherwise("All hard-gate checks passed")),
        ("Decision", c("confidence"), flagged(c("decision") == "SUSPEND"), F.concat(c("decision"), F.lit(" · risk "), F.format_string("%.1f", c("decision_score")))),
    ]
    items = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("stage"), confidence.alias("confidence"), status.alias("status"), subtitle.alias("subtitle")) for k, (name, confidence, status, subtitle) in enumerate(rows)])
    return staged.select("application_id", F.inline(items))


def review_items(staged: DataFrame) -> DataFrame:
    """What people have to look at, numbered per application in the order found: item_id, title, severity, owner
    and evidence. Where only the decision asks for a review, that is the one item."""
    c = F.col
    item = lambda title, severity, owner, evidence: F.struct(F.lit(title).alias("title"), severity.alias("severity"), F.lit(owner).alias("owner"), evidence.alias("evidence"))
    none = F.array().cast("array<struct<title:string,severity:string,owner:string,evidence:string>>")
    some = lambda holds, what: F.when(F.coalesce(holds, F.lit(False)), F.array(what)).otherwise(none)
    flags = F.transform(F.coalesce("critical_flags", F.array().cast("array<string>")), lambda x: item("Critical compliance flag", F.lit("High"), "Compliance Agent", x))
    found = F.concat(
        flags,
        some(c("reported_severity").isNotNull(), item("Cross-document contradiction", F.when(c("reported_severity").isin("HIGH", "CRITICAL"), "High").otherwise("Medium"), "Document Agent", F.lit("reported by the documents"))),
        some(c("n_missing_documents") > 0, item("Missing documents", F.lit("Medium"), "Document Agent", F.concat(F.lit("Missing: "), c("n_missing_documents").cast("string")))),
        some(F.coalesce("estimated_value", F.lit(0.0)) <= 0, item("Property valuation unavailable", F.lit("High"), "Property Agent", F.lit("No comparable listings were found."))),
    )
    alone = some(c("human_review"), item("Decision requires human review", F.lit("Medium"), "Decision Agent", c("rationale")))
    rows = staged.withColumn("items", found).withColumn("items", F.when(F.size("items") > 0, c("items")).otherwise(alone))
    # of posexplode() the optimizer infers a filter on the items, which would work out all they come from once more
    rows = rows.select("application_id", F.posexplode_outer("items").alias("k", "x")).where("x is not null")
    number = F.concat(F.lit("RV-"), c("application_id").cast("string"), F.lit("-"), (c("k") + 1).cast("string"))
    return rows.select("application_id", number.alias("item_id"), "x.title", "x.severity", "x.owner", "x.evidence")
