"""Checks of single fields; all are columns, so they stay in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.columns import dated, rounded
from loanloom.operators.documents import month

#: The format of a PAN (its fourth letter is the holder's kind) and the ages allowed.
PAN = "^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$"
YOUNGEST, OLDEST = 21, 65


def pan_checks(df: DataFrame, pan: str, name: str) -> DataFrame:
    """pan_valid, for valid numbers whether the holder is no individual and, for individuals, whether the fifth
    letter differs from the surname's, and the severity: ERROR, WARNING or INFO. A null number is not valid; a null
    name gives no surname warning."""
    number = F.upper(F.regexp_replace(pan, " ", ""))
    valid = F.coalesce(number.rlike(PAN), F.lit(False))
    surname = F.upper(F.substring(F.element_at(F.split(F.trim(name), " +"), -1), 1, 1))
    person = F.substring(number, 4, 1) == "P"
    df = df.withColumns({
        "pan_valid": valid,
        "pan_not_individual": valid & ~person,
        "pan_other_surname": valid & person & F.coalesce(F.substring(number, 5, 1) != surname, F.lit(False)),
    })
    return df.withColumn("severity", F.when(~F.col("pan_valid"), "ERROR").when(F.col("pan_not_individual") | F.col("pan_other_surname"), "WARNING").otherwise("INFO"))


#: Formats of a birth date; a bare year counts too.
BORN = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yy")


def _born(text: Column) -> Column:
    *whole, short = [dated(F.trim(text), f) for f in BORN]
    # years of two digits are those from 1969 to 2068
    return F.coalesce(*whole, F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short))


def _year(text: Column) -> Column:
    return F.when(F.trim(text).rlike("^[0-9]{4}$"), F.trim(text).cast("int"))


def age(text: Column, as_of: str) -> Column:
    """Complete years from a date text to as_of, or from a bare year; null where it is neither."""
    today = F.lit(as_of).cast("date")
    return _age(_born(text), text, today)


def _age(whole: Column, text: Column, today: Column) -> Column:
    return F.coalesce(F.floor(F.months_between(today, whole) / 12), F.year(today) - _year(text)).cast("int")


def age_allowed(text: Column, as_of: str) -> Column:
    """Whether the age is within the limits; a bare year is taken as it is."""
    return F.coalesce(F.when(_born(text).isNotNull(), age(text, as_of).between(YOUNGEST, OLDEST)), _year(text).isNotNull(), F.lit(False))


def latest_decision(cases: DataFrame, log: DataFrame) -> DataFrame:
    """application_id of each case with its last audited decision, null where there is none."""
    last = log.groupBy("application_id").agg(F.max_by("decision", "seq").alias("latest_decision"), F.count("*").alias("n_audited"))
    return cases.select("application_id").join(last, "application_id", "left").select("application_id", "latest_decision", F.coalesce("n_audited", F.lit(0)).alias("n_audited"))


def _result(*cases: tuple[Column | None, str, bool, str, Column | str]) -> Column:
    """The first case whose condition holds (None: always) as a struct (field, is_valid, severity, message)."""
    out = None
    for condition, field, valid, severity, message in reversed(cases):
        text = F.lit(message) if isinstance(message, str) else message
        row = F.struct(F.lit(field).alias("field"), F.lit(valid).alias("is_valid"), F.lit(severity).alias("severity"), text.alias("message"))
        out = row if condition is None else F.when(F.coalesce(condition, F.lit(False)), row).otherwise(out)
    return out


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _money(x: Column) -> Column:
    return _say("₹", F.format_number(x, 2))


def pan_result(number: Column, surname: Column) -> Column:
    clean = F.upper(F.trim(number))
    fourth, fifth, initial = F.substring(clean, 4, 1), F.substring(clean, 5, 1), F.upper(F.substring(F.trim(surname), 1, 1))
    return _result(
        (_blank(number), "pan_number", False, "ERROR", "PAN Number is missing."),
        (~clean.rlike(PAN), "pan_number", False, "ERROR", _say("Invalid PAN format '", clean, "'. Must be 5 uppercase letters, 4 digits, 1 letter.")),
        (fourth != "P", "pan_number", True, "WARNING", _say("PAN entity type is '", fourth, "' (Non-individual). Individual home loan applicant usually has 'P'.")),
        ((initial != "") & (fifth != initial), "pan_number", True, "WARNING", _say("PAN 5th character '", fifth, "' does not match applicant surname initial '", initial, "'.")),
        (None, "pan_number", True, "INFO", _say("Valid PAN: ", clean, " (Individual)")),
    )


def aadhaar_result(number: Column) -> Column:
    clean = F.upper(F.regexp_replace(number, "[ -]", ""))
    masked = F.contains(clean, F.lit("X"))
    return _result(
        (_blank(number), "aadhaar_number", False, "ERROR", "Aadhaar Number is missing."),
        (masked & clean.rlike("^X{8}[0-9]{4}$"), "aadhaar_number", True, "INFO", "Valid Masked Aadhaar (complies with RBI/UIDAI data privacy)."),
        (masked, "aadhaar_number", False, "ERROR", "Invalid masked Aadhaar format."),
        (clean.rlike("^[01][0-9]{11}$"), "aadhaar_number", False, "ERROR", "Aadhaar number cannot start with 0 or 1."),
        (clean.rlike("^[0-9]{12}$"), "aadhaar_number", True, "INFO", "Valid 12-digit Aadhaar number format."),
        (None, "aadhaar_number", False, "ERROR", _say("Invalid Aadhaar format: '", number, "'.")),
    )


def ifsc_result(code: Column) -> Column:
    clean = F.upper(F.trim(code))
    return _result(
        (_blank(code), "ifsc_code", False, "ERROR", "Bank IFSC Code is missing."),
        (~clean.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), "ifsc_code", False, "ERROR", _say("Invalid IFSC code '", clean, "'. Format must be 4 letters, '0', followed by 6 alphanumeric characters.")),
        (None, "ifsc_code", True, "INFO", _say("Valid IFSC Code: ", clean)),
    )


def salary_result(gross: Column, net: Column, less: Column, earnings: Column) -> Column:
    """Gross less deductions against net, within 2; the sum of the earnings lines (null or 0: none) within 5 of gross."""
    g, n, d = (F.coalesce(x, F.lit(0.0)) for x in (gross, net, less))
    off = F.abs(g - d - n)
    mismatch = _say("Payslip arithmetic mismatch: Gross (", _money(g), ") - Deductions (", _money(d), ") = ", _money(g - d), ", but Net Pay is ", _money(n), " (Variance: ", _money(off), ")")
    return _result(
        ((g <= 0) | (n <= 0), "salary_math", False, "ERROR", "Gross or Net Salary is zero/missing."),
        (off > 2, "salary_math", False, "ERROR", mismatch),
        ((earnings != 0) & (F.abs(earnings - g) > 5), "salary_math", True, "WARNING", _say("Sum of itemized earnings (", _money(earnings), ") differs slightly from Gross Salary (", _money(g), ").")),
        (None, "salary_math", True, "INFO", "Salary arithmetic perfectly reconciled (Gross = Net + Deductions)."),
    )


def recency_result(said: Column, as_of: str, window: int = 3, m: Column | None = None) -> Column:
    """m is month(said), where it is at hand."""
    m, today = month(said) if m is None else m, F.lit(as_of).cast("date")
    old = (F.year(today) - F.year(m)) * 12 + F.month(today) - F.month(m)
    return _result(
        (_blank(said), "payslip_recency", False, "WARNING", "Payslip month/year was not found on the document."),
        (m.isNull(), "payslip_recency", False, "WARNING", _say("Could not parse payslip date: '", said, "'.")),
        (old < 0, "payslip_recency", False, "WARNING", _say("Payslip for ", said, f" is dated in the future relative to today ({as_of}).")),
        (old > window, "payslip_recency", False, "WARNING", _say("Payslip for ", said, " is ", old, f" months old, outside the required last-{window}-months window.")),
        (None, "payslip_recency", True, "INFO", _say("Payslip for ", said, f" is within the last {window} months.")),
    )


def years_result(assessment: Column, financial: Column) -> Column:
    start = lambda x: F.regexp_extract(x, "([0-9]{4})", 1).try_cast("int")
    a, f = start(assessment), start(financial)
    expected = _say(f + 1, "-", F.right((f + 2).cast("string"), F.lit(2)))
    return _result(
        (_blank(assessment) | _blank(financial), "assessment_year", True, "INFO", "AY or FY not provided."),
        (a != f + 1, "assessment_year", False, "ERROR", _say("Assessment Year '", assessment, "' is inconsistent with Financial Year '", financial, "' (Expected AY ", expected, ").")),
        (None, "assessment_year", True, "INFO", _say("Valid AY ", assessment, " for FY ", financial, ".")),
    )


def age_result(born: Column, as_of: str, whole: Column | None = None, years: Column | None = None) -> Column:
    """whole and years are the date and the age that born says, where they are at hand."""
    whole, years = _born(born) if whole is None else whole, age(born, as_of) if years is None else years
    return _result(
        (_blank(born), "dob", False, "ERROR", "Date of Birth is missing."),
        (whole.isNull() & _year(born).isNotNull(), "dob", True, "INFO", _say("Calculated age from YOB: ", years, " years.")),
        (whole.isNull(), "dob", False, "WARNING", _say("Could not parse DOB format: '", born, "'.")),
        (years < YOUNGEST, "age", False, "ERROR", _say("Applicant age (", years, " yrs) is below minimum underwriting threshold (21 yrs).")),
        (years > OLDEST, "age", False, "WARNING", _say("Applicant age (", years, " yrs) exceeds standard loan maturity threshold (65 yrs).")),
        (None, "age", True, "INFO", _say("Applicant age is ", years, " years (within eligible 21-65 range).")),
    )


def validations(df: DataFrame, as_of: str, key: str = "application_id") -> DataFrame:
    """key, field, is_valid, severity, message: a row for each check of each application, from one projection over its
    columns pan_number, surname, aadhaar_number, ifsc_code, gross_salary, net_salary, total_deductions, earnings_sum, month_year,
    assessment_year, financial_year and dob. What is null is missing; each check says what that means."""
    c = F.col
    # dates are read once, in a projection of their own; the checks ask for them again and again
    df = df.withColumns({"_month": month(c("month_year")), "_born": _born(c("dob"))}).withColumn("_age", _age(c("_born"), c("dob"), F.lit(as_of).cast("date")))
    checks = F.array(
        pan_result(c("pan_number"), c("surname")), aadhaar_result(c("aadhaar_number")), ifsc_result(c("ifsc_code")),
        salary_result(c("gross_salary"), c("net_salary"), c("total_deductions"), c("earnings_sum")), recency_result(c("month_year"), as_of, m=c("_month")),
        years_result(c("assessment_year"), c("financial_year")), age_result(c("dob"), as_of, c("_born"), c("_age")),
    )
    return df.select(key, F.inline_outer(checks))


def failure_rates(rows: DataFrame) -> DataFrame:
    """field, n, n_failed, n_warnings and failure_rate (percent) of the rows of validations()."""
    failed = F.count_if(~F.col("is_valid"))
    return rows.groupBy("field").agg(F.count("*").alias("n"), failed.alias("n_failed"), F.count_if(F.col("severity") == "WARNING").alias("n_warnings"), rounded(100.0 * failed / F.count("*"), 2).alias("failure_rate"))
