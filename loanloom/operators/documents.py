"""Texts of loan documents: class, typed fields and bank transactions, as columns of one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.functions.columns import dated, lookup, rounded

#: The classes in the order that decides ties, with parts of file names, words and their weights,
#: and patterns (2.5 each).
CLASSES = ("PAN_CARD", "AADHAAR_CARD", "SALARY_SLIP", "FORM_16", "ITR", "BANK_STATEMENT", "PROPERTY_DEED")
FILE_PARTS = {
    "PAN_CARD": (2.0, ("pan",)), "AADHAAR_CARD": (2.0, ("aadhaar", "aadhar")), "SALARY_SLIP": (2.5, ("salary", "payslip", "pay_slip")), "FORM_16": (2.5, ("form16", "form_16")),
    "ITR": (2.5, ("itr", "tax_return")), "BANK_STATEMENT": (2.5, ("bank", "statement")), "PROPERTY_DEED": (2.0, ("property", "deed", "sale")),
}
WORDS = {
    "PAN_CARD": {"income tax department": 3.0, "permanent account number": 3.5, "govt. of india": 1.5, "father's name": 1.5, "date of birth": 1.0, "pan": 1.0, "signature": 0.5},
    "AADHAAR_CARD": {"unique identification authority of india": 4.0, "uidai": 3.0, "mera aadhaar": 3.0, "government of india": 1.5, "enrolment no": 2.0, "aadhaar": 2.5, "vid": 1.5, "male": 0.5, "female": 0.5, "help@uidai.gov.in": 2.0},
    "SALARY_SLIP": {"salary slip": 3.5, "payslip": 3.5, "pay slip": 3.5, "earnings": 2.0, "deductions": 2.0, "gross salary": 2.5, "net pay": 3.0, "basic pay": 2.0, "hra": 1.5, "provident fund": 1.5, "pf": 1.0, "employee id": 1.5, "employee code": 1.5, "designation": 1.0},
    "FORM_16": {"form no. 16": 4.0, "form 16": 3.5, "section 203": 3.0, "income-tax act, 1961": 2.5, "tan of deductor": 3.0, "tan of the deductor": 3.0, "pan of employee": 2.5, "pan of the employee": 2.5, "assessment year": 2.0, "quarter": 1.5, "total tax deducted": 2.0, "summary of tax deducted": 2.0},
    "ITR": {"indian income tax return": 4.0, "itr-v": 4.0, "itr-1": 3.5, "itr-2": 3.5, "acknowledgement number": 3.0, "gross total income": 2.5, "total taxable income": 2.5, "e-filing": 2.0, "income tax return verification form": 4.0},
    "BANK_STATEMENT": {"account statement": 3.5, "statement of account": 3.5, "bank statement": 3.5, "account number": 2.0, "ifsc": 2.5, "opening balance": 2.5, "closing balance": 2.5, "withdrawal": 1.5, "deposit": 1.5, "transaction date": 2.0, "narration": 1.5, "chq/ref no": 1.5, "dr / cr": 1.5},
    "PROPERTY_DEED": {"sale deed": 4.0, "deed of sale": 4.0, "allotment letter": 3.5, "possession letter": 3.0, "schedule property": 3.0, "sub-registrar": 3.0, "vendor": 2.0, "purchaser": 2.0, "consideration amount": 2.5, "super built-up area": 2.5, "carpet area": 2.5, "survey no": 2.0, "khata": 2.0, "flat no": 1.5},
}
ANCHORS = {
    "PAN_CARD": (r"[A-Z]{5}[0-9]{4}[A-Z]", r"(?i)Permanent\s+Account\s+Number"),
    "AADHAAR_CARD": (r"\b[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}\b", r"\b[X0-9]{4}[-\s][X0-9]{4}[-\s][0-9]{4}\b", r"(?i)UIDAI|Unique\s+Identification"),
    "FORM_16": (r"(?i)Form\s+(?:No\.?\s*)?16\b", r"(?i)TAN\s*(?:of\s+the\s+deductor)?\s*[:\-]\s*[A-Z]{4}[0-9]{5}[A-Z]"),
    "ITR": (r"(?i)ITR-V|ITR-[1-7]", r"(?i)Acknowledgment\s+Number"),
    "BANK_STATEMENT": (r"(?i)IFSC\s*(?:Code)?\s*[:\-]?\s*[A-Z]{4}0[A-Z0-9]{6}", r"(?i)Account\s+No|Statement\s+Period"),
    "SALARY_SLIP": (r"(?i)Gross\s+Salary|Net\s+(?:Pay|Salary)", r"(?i)Basic\s+(?:Pay|Salary)|HRA|Provident\s+Fund"),
    "PROPERTY_DEED": (r"(?i)Sale\s+Deed|Agreement\s+for\s+Sale|Allotment\s+Letter", r"(?i)Schedule\s+['\"]?A['\"]?|Schedule\s+Property"),
}
#: Of each pattern without case, parts (lower case) of which a text that it matches has at least one. They
#: are looked for before the pattern is.
NEEDS = {
    r"(?i)Permanent\s+Account\s+Number": ("permanent",), r"(?i)UIDAI|Unique\s+Identification": ("uidai", "unique"), r"(?i)Form\s+(?:No\.?\s*)?16\b": ("form",),
    r"(?i)TAN\s*(?:of\s+the\s+deductor)?\s*[:\-]\s*[A-Z]{4}[0-9]{5}[A-Z]": ("tan",), r"(?i)ITR-V|ITR-[1-7]": ("itr-",), r"(?i)Acknowledgment\s+Number": ("acknowledgment",),
    r"(?i)IFSC\s*(?:Code)?\s*[:\-]?\s*[A-Z]{4}0[A-Z0-9]{6}": ("ifsc",), r"(?i)Account\s+No|Statement\s+Period": ("account", "statement"), r"(?i)Gross\s+Salary|Net\s+(?:Pay|Salary)": ("gross", "net"),
    r"(?i)Basic\s+(?:Pay|Salary)|HRA|Provident\s+Fund": ("basic", "hra", "provident"), r"(?i)Sale\s+Deed|Agreement\s+for\s+Sale|Allotment\s+Letter": ("sale", "allotment"), r"(?i)Schedule\s+['\"]?A['\"]?|Schedule\s+Property": ("schedule",),
}
#: Parts that several words have; a word with one is looked for only where the part is.
SHARED = ("income", "account", "india", "aadhaar", "uidai", "male", "pay", "salary", "employee", "deduct", "form", "itr-", "statement", "balance", "deed", "letter", " area", " no", "schedule")
_MONEY = r"\s*[:\-]?\s*\n?\s*(?:INR|Rs\.?|₹)?\s*([0-9,]+\.?[0-9]*)"
_DATE = r"([0-3]?[0-9][/\-][0-1]?[0-9][/\-][1-2][0-9]{3})"
_YEARS = r"\s*[:\-]?\s*(20[2-3][0-9]\s*[-/]\s*[0-3][0-9]|20[2-3][0-9])"
_SQFT = r"\s*[:\-]?\s*\n?\s*([0-9,]+\.?[0-9]*)\s*(?:Sq\.?\s*Ft\.?|Square\s*Feet|sqft)"
_PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
_PIN = r"\b([1-9][0-9]{5})\b"
_REST = r"\s*\n?\s*"
#: The text fields of each class, by patterns of which the first that matches counts.
TEXTS = {
    "PAN_CARD": {
        "pan_number": (_PAN,), "dob": (r"(?i)(?:DOB|Date\s+of\s+Birth|Date\s*[:\-])\s*" + _DATE, r"\b([0-3][0-9]/[0-1][0-9]/[1-2][0-9]{3})\b"),
        "full_name": (r"(?i)(?:Name|Name\s*[:\-])\s*([A-Za-z\s]{3,40})(?:\n|Father|DOB|$)", r"(?i)Name\s*[:\-]\s*([A-Za-z ]{3,40})"), "father_name": (r"(?i)(?:Father(?:'s)?\s*Name\s*[:\-])\s*([A-Za-z\s]{3,40})(?:\n|DOB|Date|$)",),
    },
    "AADHAAR_CARD": {
        "aadhaar_number": (r"\b([X0-9]{4}[-\s][X0-9]{4}[-\s][0-9]{4}|[0-9]{12})\b",), "full_name": (r"(?i)(?:Name\s*[:\-]|To\s*[:\-])\s*([A-Za-z\s]{3,40})(?:\n|DOB|Year|Address|Gender|$)",),
        "dob": (r"(?i)(?:DOB|Date\s+of\s+Birth|Year\s+of\s+Birth|YOB)\s*[:\-]?\s*([0-3]?[0-9][/\-][0-1]?[0-9][/\-][1-2][0-9]{3}|[0-9]{4})",), "pincode": (_PIN,),
        "address": (r"(?i)Address\s*[:\-]\s*([A-Za-z0-9 ,\-/\.]{10,250})",),
    },
    "SALARY_SLIP": {
        "employer_name": (r"(?i)(?:Company|Employer|Organization|Organisation)\s*(?:Name)?\s*[:\-]\s*([A-Za-z0-9 \.,&]+)(?:\n|$)",), "employee_name": (r"(?i)(?:Employee\s*Name\s*[:\-]?|Name\s*[:\-])\s*([A-Za-z \.]{3,40})(?:\n|Employee\s*ID|Emp\s*Code|Designation|$)",),
        "employee_id": (r"(?i)(?:Employee\s*ID|Emp\s*ID|Emp\s*Code|Staff\s*No)\s*[:\-]?\s*([A-Za-z0-9\-]+)",), "designation": (r"(?i)(?:Designation|Job\s*Title|Role)\s*[:\-]?\s*([A-Za-z0-9 \.\-]+)",),
        "month_year": (r"(?i)(?:Payslip\s+for\s+(?:the\s+month\s+of\s+)?|Pay\s+Period\s*[:\-]?\s*|Month\s*[:\-]?\s*)([A-Za-z]+\s*[\-,\s]?\s*20[2-3][0-9]|[0-9]{1,2}[/\-]20[2-3][0-9])",),
    },
    "FORM_16": {
        "employer_tan": (r"(?i)TAN\s*(?:of\s+the\s+deductor)?\s*[:\-]?\s*([A-Z]{4}[0-9]{5}[A-Z])",), "employer_name": (r"(?i)(?:Name\s+(?:and\s+address\s+)?of\s+the\s+Employer/Deductor|Employer\s*Name)\s*[:\-]?\s*([A-Za-z0-9 \.,&]+)",),
        "employee_pan": (r"(?i)PAN\s*(?:of\s+the\s+employee)?\s*[:\-]?\s*([A-Z]{5}[0-9]{4}[A-Z])",), "employee_name": (r"(?i)(?:Name\s+of\s+the\s+Employee|Employee\s*Name)\s*[:\-]?\s*([A-Za-z \.]{3,40})",),
        "assessment_year": (r"(?i)(?:Assessment\s*Year|AY)" + _YEARS,), "financial_year": (r"(?i)(?:Financial\s*Year|Period\s+with\s+the\s+Employer|FY)" + _YEARS,),
    },
    "ITR": {
        "acknowledgement_number": (r"(?i)(?:Acknowledgement\s*(?:Number|No\.?)|Ack\s*No)\s*[:\-]?\s*([0-9]{10,20})",), "pan_number": (_PAN,), "assessment_year": (r"(?i)(?:Assessment\s*Year|AY)" + _YEARS,), "form_type": (r"(?i)\b(ITR-[1-7]|ITR-V)\b",),
    },
    "BANK_STATEMENT": {
        "account_holder": (r"(?i)(?:Account\s*Holder(?:\s*Name)?|Customer\s*Name)\s*[:\-]?\s*\n?\s*([A-Za-z \.]{3,40})",), "account_number": (r"(?i)(?:Account\s*(?:Number|No\.?)|A/C\s*No\.?)\s*[:\-]?\s*\n?\s*([0-9]{9,18})",),
        "ifsc_code": (r"\b([A-Z]{4}0[A-Z0-9]{6})\b",), "period_start": (r"(?i)(?:Statement\s*Period|Period\s*[:\-])\s*[:\-]?\s*\n?\s*" + _DATE + r"\s*(?:to|-)",), "period_end": (r"(?i)(?:Statement\s*Period|Period\s*[:\-])\s*[:\-]?\s*\n?\s*[0-9/\-]+\s*(?:to|-)\s*" + _DATE,),
    },
    "PROPERTY_DEED": {
        "buyer": (r"(?i)(?:Purchaser\s*/\s*Buyer|Purchaser|Buyer|Allottee|In\s+favour\s+of)\s*[:\-]?\s*\n?\s*([A-Za-z \.]{3,40})",), "seller": (r"(?i)(?:Vendor\s*/\s*Developer|Vendor|Seller|Developer|Builder|Promoter)\s*[:\-]?\s*\n?\s*([A-Za-z0-9 \.,&]{3,50})",),
        "property_address": (r"(?i)Property Address\s*:?\s*([^\n]+)",), "registration_number": (r"(?i)(?:Registration\s*Number|Registration\s*No\.?|Doc\s*No\.?|Document\s*No\.?)\s*[:\-]?\s*\n?\s*([A-Za-z0-9\-/\.]+)",), "pincode": (_PIN,),
    },
}
#: The amounts of each class.
AMOUNTS = {
    "SALARY_SLIP": {"gross_salary": r"(?i)(?:Gross\s*(?:Salary|Earnings|Pay|Amount)?)" + _MONEY, "net_salary": r"(?i)(?:Net\s*(?:Salary|Pay|Amount|Take\s*Home)?)" + _MONEY, "total_deductions": r"(?i)(?:Total\s*Deductions?)" + _MONEY},
    "FORM_16": {"gross_salary": r"(?i)(?:Gross\s*Salary[^\n:]*|Salary\s*as\s*per\s*provisions\s*contained\s*in\s*section\s*17\(1\))" + _MONEY, "deductions": r"(?i)(?:Total\s*deductions[^\n:]*|Aggregate\s*of\s*deductible\s*amount\s*under\s*Chapter\s*VI-A)" + _MONEY, "taxable_income": r"(?i)(?:Total\s*Taxable\s*Income|Taxable\s*Income|Income\s*chargeable\s*under\s*the\s*head\s*'Salaries')" + _MONEY, "tax_deducted": r"(?i)(?:Total\s*(?:TDS|Tax\s*Deducted)|Tax\s*payable|Total\s*amount\s*of\s*tax\s*deducted\s*at\s*source)" + _MONEY},
    "ITR": {"gross_income": r"(?i)(?:Gross\s*Total\s*Income|Total\s*Income)" + _MONEY, "taxable_income": r"(?i)(?:Total\s*Taxable\s*Income|Net\s*Taxable\s*Income)" + _MONEY, "deductions": r"(?i)(?:Total\s*Deductions|Deductions\s*under\s*Chapter\s*VI-A)" + _MONEY, "tax_paid": r"(?i)(?:Total\s*Tax\s*(?:Paid|Payable)|Taxes\s*Paid)" + _MONEY},
    "BANK_STATEMENT": {"average_balance": r"(?i)(?:Average\s*(?:Monthly\s*)?Balance(?:\s*\([^)]+\))?|AMB)" + _MONEY, "closing_balance": r"(?i)(?:Closing\s*Balance|Ending\s*Balance)" + _MONEY},
    "PROPERTY_DEED": {"super_area": r"(?i)(?:Super\s*Built-?up\s*Area|Built-?up\s*Area|SBUA)" + _SQFT, "carpet_area": r"(?i)Carpet\s*Area" + _SQFT, "plot_area": r"(?i)(?:Plot|Land)\s*Area" + _SQFT, "value": r"(?i)(?:Consideration\s*(?:Amount|Value)?|Total\s*Sale\s*Price|Purchase\s*Price|Sale\s*Consideration)" + _MONEY},
}
EARNINGS = {"Basic Pay": r"(?i)(?:Basic(?:\s*Pay|\s*Salary)?)", "HRA": r"(?i)(?:House\s*Rent\s*Allowance|HRA)", "Special Allowance": r"(?i)(?:Special\s*Allowance|Spl\s*Allow)", "Conveyance Allowance": r"(?i)(?:Conveyance|Transport\s*Allowance)", "Medical Allowance": r"(?i)(?:Medical\s*Allowance)"}
DEDUCTIONS = {"Provident Fund (PF)": r"(?i)(?:Provident\s*Fund|EPF|PF)", "Professional Tax (PT)": r"(?i)(?:Professional\s*Tax|PT)", "Income Tax / TDS": r"(?i)(?:Income\s*Tax|TDS|Tax\s*Deducted)", "Loan Deduction": r"(?i)(?:Loan\s*(?:EMI|Deduction|Recovery))"}
#: The kind of holder by the fourth letter of a PAN; banks, and cities of deeds, the first found counts.
ENTITIES = {"P": "Individual", "C": "Company", "H": "Hindu Undivided Family (HUF)", "F": "Partnership Firm / LLP", "A": "Association of Persons (AOP)", "T": "Trust", "B": "Body of Individuals (BOI)", "G": "Government Agency", "J": "Artificial Juridical Person", "L": "Local Authority"}
BANKS = ("HDFC Bank", "State Bank of India", "SBI", "ICICI Bank", "Axis Bank", "Kotak Mahindra Bank", "Bank of Baroda", "Punjab National Bank", "PNB", "Canara Bank", "Union Bank of India", "IndusInd Bank", "IDFC FIRST Bank", "Standard Chartered", "Citibank", "Federal Bank")
CITIES = ("Bengaluru", "Bangalore", "Mumbai", "Delhi", "Hyderabad", "Chennai", "Pune", "Kolkata", "Noida", "Gurugram", "Ahmedabad", "Coimbatore", "Madurai", "Tiruchirappalli", "Tiruppur", "Erode", "Tirunelveli", "Vellore")
#: Words of transaction lines, tested in upper case; salaries first.
SALARY = ("SALARY", "SAL CR", "PAYROLL", "ACH SALARY", "CMS SALARY")
LOAN = ("EMI", "LOAN", "NACH DEBIT", "ACH DEBIT", "HDFC LOAN", "BAJAJ", "HOME LOAN", "PERSONAL LOAN")
SALARY_LINE = ("SALARY CREDIT", "SAL CR", "PAYROLL")
BOUNCE = ("INWARD RETURN", "ECS BOUNCE", "NACH RETURN", "CHEQUE RETURN", "INSUFFICIENT FUNDS")
AMOUNT = r"\b([0-9,]+\.[0-9]{2})\b"


def _holds(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(x, F.lit(part))
    return out


def _has(low: Column, word: str) -> Column:
    part = next((p for p in SHARED if p in word and p != word), None)
    holds = F.contains(low, F.lit(word))
    return holds if part is None else F.contains(low, F.lit(part)) & holds


def class_scores(text: Column, name: Column, has_tables: Column | None = None, low: Column | None = None) -> dict[str, Column]:
    """The score of each class for a document's text and file name; low is the text in lower case, where it is at hand."""
    low, file = F.lower(text) if low is None else low, F.lower(name)
    scores = {}
    for kind in CLASSES:
        boost, parts = FILE_PARTS[kind]
        score = F.when(_holds(file, parts), boost).otherwise(0.0)
        for word, weight in WORDS[kind].items():
            score = score + F.when(_has(low, word), weight).otherwise(0.0)
        for pattern in ANCHORS[kind]:
            fits = _holds(low, NEEDS[pattern]) & text.rlike(pattern) if pattern in NEEDS else text.rlike(pattern)
            score = score + F.when(fits, 2.5).otherwise(0.0)
        if has_tables is not None and kind in ("BANK_STATEMENT", "SALARY_SLIP", "FORM_16"):
            score = score + F.when(has_tables, 1.0).otherwise(0.0)
        scores[kind] = score
    return scores


def classified(docs: DataFrame, text: str = "text", name: str = "filename") -> DataFrame:
    """docs with doc_class and class_confidence: the class of the highest score, the first on a tie; below 2.0
    UNKNOWN with 0.30. A null text scores by its name alone."""
    docs = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_low", F.lower("_text"))
    scores = list(class_scores(F.col("_text"), F.coalesce(name, F.lit("")), low=F.col("_low")).values())
    # each score stands here twice, whatever column is asked for: Spark then makes a method of its own of each, and all are
    # short enough to be compiled; one long method of all words and patterns would be interpreted
    at = F.array_position(F.array(*scores), F.greatest(*scores, F.lit(2.0)))
    df = docs.withColumns({"_at": at.cast("int"), "_best": F.greatest(*scores)})
    confidence = rounded(F.least(F.lit(0.99), F.greatest(F.lit(0.60), 0.50 + F.col("_best") / 25.0)), 3)
    return df.withColumns({"doc_class": F.get(F.array(*map(F.lit, ("UNKNOWN", *CLASSES))), F.col("_at")), "class_confidence": F.when(F.col("_at") == 0, 0.30).otherwise(confidence)}).drop("_at", "_best", "_text", "_low")


def found(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first group of the first pattern that matches, trimmed; null where none does."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1), F.lit(" \t\n\r")), F.lit("")) for p in patterns])


def amount(text: Column, pattern: str) -> Column:
    # what isn't there is null before the cast: a cast that fails throws for each row
    return F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ""), F.lit("")).try_cast("double")


def matched(kind: str, t: Column) -> dict[str, Column]:
    """What the patterns of one class's fields match in a text, before anything is worked out from it; amounts that
    aren't found are 0 (areas and values: null). Names with an underscore are of use to fields() alone."""
    raw = {n: found(t, p) for n, p in TEXTS[kind].items()}
    raw |= {n: amount(t, p) if kind == "PROPERTY_DEED" else F.coalesce(amount(t, p), F.lit(0.0)) for n, p in AMOUNTS.get(kind, {}).items()}
    if kind == "AADHAAR_CARD":
        raw["gender"] = F.when(t.rlike(r"(?i)\b(?:MALE|PURUSH)\b"), "Male").when(t.rlike(r"(?i)\b(?:FEMALE|MAHILA)\b"), "Female").when(t.rlike(r"(?i)\bTRANSGENDER\b"), "Other")
    if kind == "SALARY_SLIP":
        raw |= {f"_{n}": amount(t, p + _MONEY) for n, p in (EARNINGS | DEDUCTIONS).items()}
    if kind == "BANK_STATEMENT":
        raw["bank_name"] = F.coalesce(*[F.when(t.rlike(rf"(?i)\b{b}\b"), b) for b in BANKS], F.lit("Scheduled Commercial Bank"))
    if kind == "PROPERTY_DEED":
        raw["title"] = F.when(t.rlike(r"(?i)Allotment\s+Letter"), "Allotment Letter").when(t.rlike(r"(?i)Possession\s+(?:Certificate|Letter)"), "Possession Certificate").when(t.rlike(r"(?i)Agreement\s+for\s+Sale"), "Agreement for Sale").otherwise("Sale Deed")
        # all names at once, then the first in the list of those that are there
        named = F.transform(F.regexp_extract_all(t, F.lit(rf"(?i)\b({'|'.join(CITIES)})\b"), F.lit(1)), F.lower)
        raw["city"] = F.initcap(F.get(F.array_intersect(F.array(*[F.lit(c.lower()) for c in CITIES]), named), F.lit(0)))
        raw["_plot"] = t.rlike(r"(?i)Property\s*Type:\s*\n?\s*(?:Residential\s+)?(?:Plot|Land)\b")
    return raw


def with_dashes(number: Column) -> Column:
    """An Aadhaar number as it is given out."""
    return F.regexp_replace(number, " ", "-")


def fields(docs: DataFrame, kind: str, key: str = "application_id", text: str = "text") -> DataFrame:
    """The typed fields of documents of one class; amounts that aren't found are 0 (areas and values: null)."""
    raw = matched(kind, F.col("_t"))
    # the patterns are matched once, in a projection of their own; what follows from them is worked out behind it
    docs = docs.select(key, F.coalesce(text, F.lit("")).alias("_t")).select(key, *[v.alias(n) for n, v in raw.items()])
    columns = {n: F.col(f"`{n}`") for n in raw if not n.startswith("_")}
    for n in ("assessment_year", "financial_year"):
        if n in columns:
            columns[n] = F.regexp_replace(columns[n], " ", "")
    if kind == "PAN_CARD":
        columns["entity_type"] = F.when(columns["pan_number"].isNull(), "Individual").otherwise(lookup(F.substring(columns["pan_number"], 4, 1), ENTITIES, "Other / Unknown"))
    if kind == "AADHAAR_CARD":
        columns["aadhaar_number"] = with_dashes(columns["aadhaar_number"])
        columns["is_masked"] = F.coalesce(F.contains(F.upper(columns["aadhaar_number"]), F.lit("X")), F.lit(True))
    if kind == "SALARY_SLIP":
        part = lambda name: F.struct(F.lit(name).alias("component"), F.col(f"`_{name}`").alias("amount"))
        items = lambda table: F.filter(F.array(*[part(n) for n in table]), lambda x: x["amount"] > 0)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["amount"])
        columns |= {"earnings": items(EARNINGS), "deductions": items(DEDUCTIONS)}
        columns["total_deductions"] = F.when(columns["total_deductions"] == 0, total(columns["deductions"])).otherwise(columns["total_deductions"])
        usable = (columns["gross_salary"] > 0) & (columns["net_salary"] > 0)
        columns["adds_up"] = usable & (F.abs(columns["gross_salary"] - columns["total_deductions"] - columns["net_salary"]) <= 1.0)
    if kind == "FORM_16":
        columns["is_valid"] = columns["employer_tan"].isNotNull() & columns["employee_pan"].isNotNull() & (columns["gross_salary"] > 0)
    if kind == "ITR":
        columns["form_type"] = F.coalesce(F.upper(columns["form_type"]), F.lit("ITR-1"))
    if kind == "PROPERTY_DEED":
        plot = columns["plot_area"].isNotNull() | F.col("_plot") & columns["super_area"].isNull()
        columns["property_type"] = F.when(plot, "Residential Plot").otherwise("Residential Flat")
        columns["carpet_area"] = F.coalesce(columns["carpet_area"], columns["plot_area"])
        parts = F.filter(F.transform(F.split(columns["property_address"], ","), lambda x: F.trim(x)), lambda x: x != "")
        at = F.array_position(F.transform(parts, F.lower), F.lower(columns["city"]))
        columns["locality"] = F.when(at > 1, F.get(parts, (at - 2).cast("int")))
    return docs.select(key, *[v.alias(n) for n, v in columns.items()])


def coverage(docs: DataFrame, kind: str) -> DataFrame:
    """The share of documents of one class in which each text field was found."""
    each = fields(docs, kind)
    names = list(TEXTS[kind])
    one = each.agg(F.count("*").alias("n"), *[rounded(F.avg(F.col(x).isNotNull().cast("int")), 4).alias(x) for x in names])
    return one.select(F.lit(kind).alias("doc_class"), "n", F.inline(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("coverage")) for x in names])))


def transactions(docs: DataFrame, key: str = "application_id") -> DataFrame:
    """Salary credits and loan instalments of statement texts, one row per line that has one: key, line, category,
    amount. Statements without a salary credit in a line take, for a line that names one, the first amount of that line
    or of the five after it; a line whose first amount is zero is passed over."""
    c = F.col
    lines = docs.select(key, F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("line", "said"))
    up = F.upper(c("said"))
    every = F.transform(F.regexp_extract_all("said", F.lit(AMOUNT), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    w = W.partitionBy(key).orderBy("line")
    df = lines.withColumn("every", every).withColumns({"amounts": F.filter("every", lambda x: x > 0), "leading": F.get("every", F.lit(0)), "salary": _holds(up, SALARY), "loan": _holds(up, LOAN), "named": _holds(up, SALARY_LINE)})
    first, last = F.get("amounts", F.lit(0)), F.element_at("amounts", -1)
    second_last = F.element_at("amounts", -2)
    leading = F.when(c("leading") > 0, c("leading"))
    ahead = F.coalesce(leading, *[F.lead(leading, k).over(w) for k in range(1, 6)])
    df = df.withColumn("ahead", ahead)
    n = F.size("amounts")
    credit = F.when(n == 1, first).when((n >= 2) & (last > second_last * 1.2), second_last).when(n >= 2, first)
    df = df.withColumns({"credit": F.when(c("salary"), credit), "instalment": F.when(~c("salary") & c("loan"), first)})
    has = F.max(c("credit").isNotNull().cast("int")).over(W.partitionBy(key))
    category = F.when(c("credit").isNotNull() | ((has == 0) & c("named") & c("ahead").isNotNull()), "SALARY").when(c("instalment").isNotNull(), "LOAN_EMI")
    value = F.when(c("credit").isNotNull(), c("credit")).when((has == 0) & c("named") & c("ahead").isNotNull(), c("ahead")).otherwise(c("instalment"))
    return df.select(key, "line", category.alias("category"), value.alias("amount")).where("category is not null")


def statement_summary(found_rows: DataFrame, key: str = "application_id") -> DataFrame:
    """Of each statement's transactions: mean salary credit, instalments a month (over the number of credits, one
    at least) and the months covered (six at least)."""
    salary, loan = F.col("category") == "SALARY", F.col("category") == "LOAN_EMI"
    n = F.count_if(salary)
    return found_rows.groupBy(key).agg(n.alias("n_credits"), F.coalesce(rounded(F.avg(F.when(salary, F.col("amount"))), 2), F.lit(0.0)).alias("average_salary"), rounded(F.coalesce(F.sum(F.when(loan, F.col("amount"))), F.lit(0.0)) / F.greatest(n, F.lit(1)), 2).alias("monthly_obligations"), F.greatest(n, F.lit(6)).alias("months_covered"))


#: The formats of a month.
MONTHS = ("MMMM yyyy", "MMMM-yyyy", "MMMM,yyyy", "MMMM, yyyy", "MMM yyyy", "MMM-yyyy", "MMM,yyyy", "M/yyyy", "M-yyyy", "yyyy-M", "yyyy/M")


def month(text: Column) -> Column:
    """The first day of the month a text names, in one of MONTHS; null for others."""
    clean = F.initcap(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")))
    named = F.regexp_replace(clean, r"[-,]\s*", " ")
    return F.coalesce(*[dated(named, f) for f in ("MMMM yyyy", "MMM yyyy")], *[dated(clean, f) for f in ("M/yyyy", "M-yyyy", "yyyy-M", "yyyy/M")])


def recency(text: Column, as_of: str, window: int = 3) -> Column:
    """RECENT, OLD, FUTURE, UNREADABLE or MISSING: a payslip's month against the last months before as_of."""
    m, today = month(text), F.lit(as_of).cast("date")
    age = (F.year(today) - F.year(m)) * 12 + F.month(today) - F.month(m)
    return F.when(F.coalesce(text, F.lit("")) == "", "MISSING").when(m.isNull(), "UNREADABLE").when(age < 0, "FUTURE").when(age > window, "OLD").otherwise("RECENT")


def years_agree(assessment: Column, financial: Column) -> Column:
    """Whether the assessment year follows the financial one; missing or unreadable years do."""
    start = lambda x: F.regexp_extract(x, r"([0-9]{4})", 1).try_cast("int")
    return F.coalesce(start(assessment) == start(financial) + 1, F.lit(True))


def overridden(extracted: DataFrame, corrections: DataFrame, key: str, editable: tuple[str, ...]) -> DataFrame:
    """extracted with a reviewer's corrections (key, field, value; the last value by name order counts) of editable
    fields in place, and invalid_fields: the names of corrections that aren't editable."""
    wide = corrections.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in editable], F.array_sort(F.collect_set(F.when(~F.col("field").isin(*editable), F.col("field")))).alias("invalid_fields"))
    df = extracted.join(wide, key, "left")
    types = dict(extracted.dtypes)
    new = {f: F.coalesce(F.col(f"_{f}").try_cast(types[f]), F.col(f)) for f in editable}
    return df.withColumns(new).withColumn("invalid_fields", F.coalesce("invalid_fields", F.array().cast("array<string>"))).drop(*[f"_{f}" for f in editable])


def bundled(docs: DataFrame, key: str, order: str) -> DataFrame:
    """One row per application: the last document of each class (by order) and its slips in order."""
    kinds = [k for k in CLASSES if k != "SALARY_SLIP"]
    last = [F.max_by(F.when(F.col("doc_class") == k, F.col("text")), F.when(F.col("doc_class") == k, F.col(order))).alias(k.lower()) for k in kinds]
    slips = F.array_sort(F.collect_list(F.when(F.col("doc_class") == "SALARY_SLIP", F.struct(F.col(order).alias("place"), F.col("text").alias("text")))))
    return docs.groupBy(key).agg(*last, slips.alias("slips"))
