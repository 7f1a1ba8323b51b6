"""Credit assessment of applications, one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.config import CREDIT
from loanloom.functions.columns import clamp, lookup, present, rounded


def employment_bucket(text: Column) -> Column:
    """salaried, business or self_employed (also for anything unknown)."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[- ]", "_")
    return F.when(key.isin("salaried", "salary", "employee", "employed"), "salaried").when(key.isin("business", "businessman", "businesswoman", "proprietor", "partnership"), "business").otherwise("self_employed")


def credit_band(score: Column) -> Column:
    bounded = clamp(score, 300, 900)
    out = F.when(score.isNull(), "New-to-Credit")
    for name, least in CREDIT["bands"]:
        out = out.when(bounded >= least, name)
    return out.otherwise("Very Poor")


def risk_tier(band: Column) -> Column:
    return lookup(band, CREDIT["risk_tier"], "moderate")


def emi(principal: Column, months: Column, annual_percent: float = CREDIT["annual_rate_percent"]) -> Column:
    """Instalment of a reducing balance; no tenure gives 0, no rate an even share."""
    rate = annual_percent / 1200
    if not rate:
        return F.when(months <= 0, 0.0).otherwise(rounded(principal / months, 2))
    growth = F.pow(F.lit(1 + rate), months)
    return F.when(months <= 0, 0.0).otherwise(rounded(principal * rate * growth / (growth - 1), 2))


def flag_texts(c, multiple: Column) -> Column:
    """The red flags as texts, with their counts and amounts."""
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    count = lambda name: zero(name).cast("string")
    money = lambda x: F.format_string("%,.0f", x)
    yearly = c("monthly_income") * 12
    texts = (
        (zero("settled_accounts") > 0, F.concat(count("settled_accounts"), F.lit(" settled account(s) found in credit history"))),
        (zero("written_off_accounts") > 0, F.concat(count("written_off_accounts"), F.lit(" written-off account(s) found in credit history"))),
        (zero("max_dpd_last_12_months") > 90, F.concat(F.lit("DPD exceeding 90 days in last 12 months (max DPD: "), count("max_dpd_last_12_months"), F.lit(")"))),
        (zero("recent_enquiries_last_90_days") >= CREDIT["enquiry_limit"], F.concat(F.lit("Possible loan stacking - "), count("recent_enquiries_last_90_days"), F.lit(" credit enquiries in last 90 days"))),
        ((yearly > 0) & (c("loan_amount") > yearly * multiple), F.concat(F.lit("Requested loan amount (Rs."), money(c("loan_amount")), F.lit(") exceeds "), multiple.cast("string"), F.lit("x annual income (Rs."), money(yearly), F.lit(") - income-to-loan mismatch"))),
    )
    return F.filter(F.array(*[F.when(holds, text) for holds, text in texts]), lambda x: x.isNotNull())


#: What a flag's text holds, by category in the order tested, and what makes a flag severe.
FLAG_MARKERS = {"settled_account": "settled account", "written_off_account": "written-off account", "dpd_over_90": "dpd exceeding 90", "loan_stacking": "loan stacking", "income_to_loan_mismatch": "income-to-loan mismatch"}
SEVERE_MARKERS = ("settled account", "written-off account", "dpd exceeding 90")


def flag_category(text: Column) -> Column:
    """The category of a flag's text or code; other for what is none."""
    low, out = F.lower(text), F.lit("other")
    for name, marker in reversed(FLAG_MARKERS.items()):
        out = F.when(F.contains(low, F.lit(marker)) | F.contains(low, F.lit(name)), name).otherwise(out)
    return out


def severe_count(texts: Column) -> Column:
    """How many flag texts hold a severe marker."""
    return F.size(F.filter(texts, lambda x: F.array_contains(F.array(*[F.contains(F.lower(x), F.lit(m)) for m in SEVERE_MARKERS]), True)))


def assess(applications: DataFrame) -> DataFrame:
    """All credit columns of each application. Without a positive income, loan or tenure nothing is assessed:
    confidence is 0, there are no flags, and all else is null. foir and ltv are stored bounded to 1 and 2; the
    decision is taken on foir_raw."""
    c = F.col
    conf, weight = CREDIT["confidence"], CREDIT["weights"]
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    df = applications.withColumns({
        "usable": (zero("monthly_income") > 0) & (zero("loan_amount") > 0) & (zero("loan_tenure_months") > 0),
        "employment_bucket": employment_bucket(c("employment_type")),
        "emi": emi(c("loan_amount"), c("loan_tenure_months")),
        "card_emi": rounded(zero("credit_card_outstanding_total") * CREDIT["card_rate"], 2),
    })
    df = df.withColumn("cibil_score", F.when(c("usable"), c("cibil_score")))
    multiple = lookup(c("employment_bucket"), CREDIT["income_multiple"])
    texts = F.when(c("usable"), flag_texts(c, multiple)).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({
        "credit_band": F.when(c("usable"), credit_band(c("cibil_score"))),
        "foir_limit": lookup(c("employment_bucket"), CREDIT["foir_limit"]),
        "obligations": F.when(c("usable"), rounded(zero("existing_debt") + c("emi") + c("card_emi"), 2)),
        "ltv_raw": F.when(c("property_value") > 0, rounded(c("loan_amount") / c("property_value"), 4)),
        "flag_texts": texts,
    })
    df = df.withColumns({
        "risk_tier": F.when(c("usable"), risk_tier(c("credit_band"))),
        "foir_raw": rounded(c("obligations") / c("monthly_income"), 4),
        "flags": F.transform("flag_texts", flag_category),
        "n_flags": F.size("flag_texts"),
        "n_severe": severe_count(c("flag_texts")),
    })
    over = c("foir_raw") - c("foir_limit")
    headroom = clamp(50.0 - over / c("foir_limit") * 100.0, 0.0, 100.0)
    flag_points = F.greatest(F.lit(0.0), 100.0 - c("n_severe") * CREDIT["severe_penalty"] - (c("n_flags") - c("n_severe")) * CREDIT["mild_penalty"])
    score = lookup(c("credit_band"), CREDIT["band_points"]) * weight["band"] + headroom * weight["foir"] + flag_points * weight["flags"]
    low = F.coalesce(c("cibil_score") < CREDIT["reject_below"], F.lit(False))
    decision = (
        F.when(low & ~((over < -CREDIT["compensating_headroom"]) & (c("n_flags") == 0)), "REJECT")
        .when(over > CREDIT["foir_reject_overshoot"], "REJECT")
        .when(c("n_severe") >= 2, "REJECT")
        .when(low | (over > 0) | (c("n_flags") >= 1) | (c("credit_band") == "New-to-Credit"), "CONDITIONAL")
        .otherwise("APPROVE")
    )
    confidence = conf["base"] - F.when(c("cibil_score").isNull(), conf["no_history"]).otherwise(0.0) - c("n_flags") * conf["per_flag"]
    stable = F.when(c("n_severe") >= 1, "unstable").when(c("employment_bucket") == "salaried", "stable").otherwise("moderately_stable")
    return df.withColumns({
        "foir": F.when(c("usable"), F.least(c("foir_raw"), F.lit(1.0))),
        "ltv": F.when(c("usable"), F.least(c("ltv_raw"), F.lit(2.0))),
        "income_stability": F.when(c("usable"), stable),
        "risk_score": F.when(c("usable"), rounded(clamp(score, 0.0, 100.0), 2)),
        "credit_confidence": F.when(c("usable"), rounded(clamp(confidence, conf["floor"], 1.0), 2)).otherwise(0.0),
        "preliminary_decision": F.when(c("usable"), decision),
    })


def explanation(assessed: DataFrame) -> DataFrame:
    """application_id and sentences on each assessment."""
    c = F.col
    percent = lambda x: F.format_string("%.1f%%", rounded(x * 100, 1))
    says = F.concat_ws(" ",
        F.when(c("cibil_score").isNotNull(), F.concat(F.lit("CIBIL score of "), c("cibil_score").cast("string"), F.lit(" places the applicant in the "), F.coalesce("credit_band", F.lit("N/A")), F.lit(" band."))).otherwise("No credit history available; assessed as New-to-Credit."),
        F.when(c("foir") > 0.5, F.concat(F.lit("FOIR of "), percent(c("foir")), F.lit(" exceeds typical thresholds, indicating high debt burden."))).when(c("foir").isNotNull(), F.concat(F.lit("FOIR of "), percent(c("foir")), F.lit(" is within acceptable limits."))),
        F.when(c("ltv") > 0.8, F.concat(F.lit("LTV of "), percent(c("ltv")), F.lit(" is high, limiting equity cushion."))).when(c("ltv").isNotNull(), F.concat(F.lit("LTV of "), percent(c("ltv")), F.lit(" provides adequate collateral coverage."))),
        F.when(c("n_flags") > 0, F.concat(F.lit("Red flags detected: "), F.concat_ws(", ", "flag_texts"), F.lit("."))).otherwise("No material red flags identified."),
        F.concat(F.lit("Composite risk score: "), F.coalesce(c("risk_score").cast("string"), F.lit("None")), F.lit("/100. Preliminary decision: "), F.coalesce("preliminary_decision", F.lit("None")), F.lit(".")),
    )
    return assessed.select("application_id", says.alias("explanation"))


_BUREAU = ("settled_accounts", "written_off_accounts", "max_dpd_last_12_months", "recent_enquiries_last_90_days", "credit_card_outstanding_total")


def bureau_data(applications: DataFrame, reports: DataFrame, low: int = 300, high: int = 900) -> DataFrame:
    """The best bureau data of each application: the bureau's report (a score of 0 or less means none), else the
    declared score where it is in range, with zeros for all else; out_of_range marks a declared score that isn't
    used. Repeated reports of an application: the one with the highest score counts."""
    c = F.col
    one = reports.groupBy("application_id").agg(F.max_by(F.struct("cibil_score", *_BUREAU), F.coalesce("cibil_score", F.lit(-1))).alias("r"))
    df = applications.select("application_id", "declared_cibil").join(one, "application_id", "left")
    fits = c("declared_cibil").between(low, high)
    source = F.when(c("r").isNotNull(), "bureau").when(F.coalesce(fits, F.lit(False)), "applicant_declared").otherwise("missing")
    score = F.when(source == "bureau", F.when(c("r.cibil_score") > 0, c("r.cibil_score"))).when(source == "applicant_declared", c("declared_cibil"))
    return df.select("application_id", score.cast("int").alias("cibil_score"), source.alias("source"), (F.coalesce(~fits, F.lit(False)) & c("r").isNull()).alias("out_of_range"), (source == "bureau").alias("verified"),
        *[F.when(source != "missing", F.coalesce(c(f"r.{x}"), F.lit(0))).alias(x) for x in _BUREAU])
