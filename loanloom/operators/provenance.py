"""Fields of loan documents with where each comes from: the field, its value, the text that shows it, where that
begins and how sure it is. Labelled values come first; names and addresses without a label are taken from the lines
around them, with a lower confidence. All of it is one projection for each class of document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.columns import lookup
from loanloom.functions.names import bound
from loanloom.operators import documents as x

#: The fields of each class: name, confidence, what is shown (the whole match, the match without white
#: space around it, or the value alone) and the patterns of which the first that matches counts.
RULES = {
    "PAN_CARD": (
        ("pan_number", 0.98, "match", (r"\b([A-Z]{5}[0-9]{4}[A-Z])\b",)),
        ("dob", 0.95, "match", (r"(?i)(?:DOB|Date\s+of\s+Birth|Date\s*[:\-])\s*([0-3]?[0-9][/\-][0-1]?[0-9][/\-][1-2][0-9]{3})", r"\b([0-3][0-9]/[0-1][0-9]/[1-2][0-9]{3})\b")),
        ("full_name", 0.92, "trimmed", (r"(?i)(?:Name|Name\s*[:\-])\s*([A-Za-z\s]{3,40})(?:\n|Father|DOB|$)",)),
        ("father_name", 0.92, "trimmed", (r"(?i)(?:Father(?:'s)?\s*Name\s*[:\-])\s*([A-Za-z\s]{3,40})(?:\n|DOB|Date|$)",)),
    ),
    "AADHAAR_CARD": (
        ("aadhaar_number", 0.96, "value", (r"\b([X0-9]{4}[-\s][X0-9]{4}[-\s][0-9]{4}|[0-9]{4}\s[0-9]{4}\s[0-9]{4}|[0-9]{12})\b",)),
        ("full_name", 0.90, "trimmed", (r"(?i)(?:Name\s*[:\-]|To\s*[:\-])\s*([A-Za-z\s]{3,40})(?:\n|DOB|Year|Address|Gender|$)",)),
        ("dob", 0.94, "trimmed", (r"(?i)(?:DOB|Date\s+of\s+Birth|Year\s+of\s+Birth|YOB)\s*[:\-]?\s*([0-3]?[0-9][/\-][0-1]?[0-9][/\-][1-2][0-9]{3}|[0-9]{4})",)),
        ("pincode", 0.95, "match", (r"\b([1-9][0-9]{5})\b",)),
        ("address", 0.88, "trimmed", (r"(?i)(?:Address\s*[:\-]|Address\s*\n)\s*([A-Za-z0-9\s,\-/\.]{10,250})(?:\n[A-Z\s]+:|\b[0-9]{6}\b|$)",)),
    ),
    "SALARY_SLIP": (
        ("employer_name", 0.90, "value", (r"(?i)(?:Company|Employer|Organization|Organisation)\s*(?:Name)?\s*[:\-]\s*([A-Za-z0-9\s\.,&]+)(?:\n|$)",)),
        ("employee_name", 0.92, "trimmed", (r"(?i)(?:Employee\s*Name|Name\s*[:\-])\s*([A-Za-z\s\.]{3,40})(?:\n|Employee\s*ID|Emp\s*Code|Designation|$)", r"(?i)(?:Employee\s*Name\s*[:\-])\s*([A-Za-z\s\.]{3,40})(?:\n|$)")),
        ("employee_id", 0.95, "trimmed", (r"(?i)(?:Employee\s*ID|Emp\s*ID|Emp\s*Code|Staff\s*No)\s*[:\-]?\s*([A-Za-z0-9\-]+)",)),
        ("designation", 0.90, "trimmed", (r"(?i)(?:Designation|Job\s*Title|Role)\s*[:\-]?\s*([A-Za-z0-9\s\.\-]+)(?:\n|Department|DOJ|PAN|$)",)),
        ("month_year", 0.94, "trimmed", (r"(?i)(?:Payslip\s+for\s+(?:the\s+month\s+of\s+)?|Pay\s+Period\s*[:\-]?\s*|Month\s*[:\-]?\s*)([A-Za-z]+\s*[\-,\s]?\s*20[2-3][0-9]|[0-9]{1,2}[/\-]20[2-3][0-9])",)),
    ),
    "FORM_16": (
        ("employer_tan", 0.98, "match", (r"(?i)(?:TAN\s*(?:of\s+the\s+deductor)?\s*[:\-]?\s*)([A-Z]{4}[0-9]{5}[A-Z])",)),
        ("employer_name", 0.92, "value", (r"(?i)(?:Name\s+(?:and\s+address\s+)?of\s+the\s+Employer/Deductor|Employer\s*Name)\s*[:\-]?\s*([A-Za-z0-9\s\.,&]+)(?:\n|PAN|TAN|$)",)),
        ("employee_pan", 0.98, "match", (r"(?i)(?:PAN\s*(?:of\s+the\s+employee)?\s*[:\-]?\s*)([A-Z]{5}[0-9]{4}[A-Z])",)),
        ("employee_name", 0.92, "value", (r"(?i)(?:Name\s+of\s+the\s+Employee|Employee\s*Name)\s*[:\-]?\s*([A-Za-z\s\.]{3,40})(?:\n|PAN|Designation|$)",)),
        ("assessment_year", 0.96, "match", (r"(?i)(?:Assessment\s*Year|AY)\s*[:\-]?\s*(20[2-3][0-9]\s*[-/]\s*[0-3][0-9]|20[2-3][0-9])",)),
        ("financial_year", 0.96, "match", (r"(?i)(?:Financial\s*Year|Period\s+with\s+the\s+Employer|FY)\s*[:\-]?\s*(20[2-3][0-9]\s*[-/]\s*[0-3][0-9]|20[2-3][0-9])",)),
    ),
    "ITR": (
        ("acknowledgement_number", 0.98, "match", (r"(?i)(?:Acknowledgement\s*(?:Number|No\.?)|Ack\s*No)\s*[:\-]?\s*([0-9]{10,20})",)),
        ("pan_number", 0.98, "match", (r"\b([A-Z]{5}[0-9]{4}[A-Z])\b",)),
    ),
    "BANK_STATEMENT": (
        ("account_holder", 0.90, "value", (r"(?i)(?:Account\s*Holder(?:\s*Name)?|Customer\s*Name)\s*[:\-]?\s*\n?\s*([A-Za-z\s\.]{3,40})(?:\n|Account\s*No|A/C\s*No|Address|$)",)),
        ("account_number", 0.98, "match", (r"(?i)(?:Account\s*(?:Number|No\.?)|A/C\s*No\.?)\s*[:\-]?\s*\n?\s*([0-9]{9,18})",)),
        ("ifsc_code", 0.98, "value", (r"\b([A-Z]{4}0[A-Z0-9]{6})\b",)),
    ),
    "PROPERTY_DEED": (
        ("buyer", 0.90, "value", (r"(?i)(?:Purchaser\s*/\s*Buyer|Purchaser|Buyer|Allottee|In\s+favour\s+of)\s*[:\-]?\s*\n?\s*([A-Za-z\s\.]{3,40})(?:\n|Vendor|Seller|Son\s+of|Daughter\s+of|Property|$)",)),
        ("seller", 0.90, "value", (r"(?i)(?:Vendor\s*/\s*Developer|Vendor|Seller|Developer|Builder|Promoter)\s*[:\-]?\s*\n?\s*([A-Za-z0-9\s\.,&]{3,50})(?:\n|Purchaser|Buyer|$)",)),
        ("property_address", 0.95, "value", (r"(?is)Property Address\s*:\s*\n\s*(.*?)\n\s*(?:Super\s*Built|Carpet\s*Area|Consideration|Stamp\s*Duty)", r"(?is)Property Address\s*:\s*(.*?)(?:\n|$)", r"(?is)Property Address\s+(.*?)(?:\n|$)")),
    ),
}
#: Amounts that are shown, with their confidence and the text before (or after) them.
SHOWN = {
    "SALARY_SLIP": (("gross_salary", 0.95, "Gross Salary: ₹"), ("net_salary", 0.96, "Net Salary: ₹"), ("total_deductions", 0.93, "Total Deductions: ₹")),
    "FORM_16": (("gross_salary", 0.95, "Form 16 Gross: ₹"),),
    "PROPERTY_DEED": (("value", 0.94, "Consideration: ₹"),),
}
#: Confidence of names and addresses without a label, the words of lines that can't be names, the words that
#: mark a line as an address, the line before which a card names its holder and the labels of a statement.
WITHOUT_LABEL = {"PAN_CARD": 0.80, "AADHAAR_CARD": 0.82, "SALARY_SLIP": 0.90, "BANK_STATEMENT": 0.90}
ADDRESS_CONFIDENCE, TITLE_CONFIDENCE, BANK_CONFIDENCE, LOCALITY_CONFIDENCE, AREA_CONFIDENCE, GENDER_CONFIDENCE = 0.80, 0.95, 0.95, 0.85, 0.92, 0.98
NOT_PAN_NAMES = ("income tax", "govt", "permanent", "india", "signature")
NOT_CARD_NAMES = ("government", "uidai", "unique", "authority", "india")
NOT_EMPLOYERS = ("salary slip", "payslip", "private & confidential")
NOT_HOLDERS = ("hdfc", "sbi", "icici", "axis", "bank")
ADDRESS_WORDS = ("karnataka", "maharashtra", "delhi", "tamil nadu", "telangana", "gujarat", "flat", "road", "street")
BIRTH_LINE = r"(?i)DOB|Year\s+of\s+Birth|Date\s+of\s+Birth"
HOLDER = r"(?i)(?:Name\s*[:\-])\s*\n?\s*([A-Za-z\s\.]{3,40})(?:\n|Account|$)"
ADDRESS_ENDS = r"(?is)\n\s*(?:Super\s*Built|Carpet\s*Area|Consideration|Stamp\s*Duty).*"
#: A stated number of returned payments, and lines that say there are none.
RETURNS = r"(?i)(?:Inward\s*(?:Cheque|ECS|NACH)\s*Returns?|Bounce\s*Count)\s*[:\-]?\s*([0-9]+)"
NO_RETURNS = ("RETURNS: 0", "COUNT: 0")
GENDERS = (("Male", r"(?i)\b(?:MALE|PURUSH)\b"), ("Female", r"(?i)\b(?:FEMALE|MAHILA)\b"), ("Other", r"(?i)\bTRANSGENDER\b"))

_WHITE = " \t\n\r\f\x0b"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(_WHITE))


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in words))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once for a row."""
    return bound(lambda s: use(s["v"]), v=value)


def _item(value: Column, snippet: Column, start: Column, confidence: float) -> Column:
    """The found field as a struct; null where the value is."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), snippet.alias("snippet"), start.cast("int").alias("start"), F.lit(confidence).alias("confidence")))


def _matched(t: Column, pattern: str, confidence: float, shows: str) -> Column:
    def item(value):
        whole = F.regexp_extract(t, pattern, 0)
        snippet = value if shows == "value" else whole if shows == "match" else _trim(whole)
        return _item(value, snippet, F.regexp_instr(t, F.lit(pattern)), confidence)

    # the value is matched once; the rest is looked for only where there is one
    return once(F.nullif(_trim(F.regexp_extract(t, pattern, 1)), F.lit("")), item)


def _shown(t: Column, lines: Column, kind: str) -> dict[str, Column]:
    """The found fields of a class as structs (value, snippet, start, confidence)."""
    found = {name: [_matched(t, p, confidence, shows) for p in patterns] for name, confidence, shows, patterns in RULES[kind]}
    place = lambda v: F.nullif(F.position(v, t), F.lit(0))
    plain = lambda v, confidence: once(v, lambda w: _item(w, w, place(w), confidence))
    first = lambda xs: F.get(xs, F.lit(0))
    said = F.filter(F.transform(lines, _trim), lambda v: v != "")
    if kind == "PAN_CARD":
        found["full_name"].append(plain(first(F.filter(said, lambda v: ~_holds(v, NOT_PAN_NAMES))), WITHOUT_LABEL[kind]))
    if kind == "AADHAAR_CARD":
        rest = F.greatest(F.size(said) - 1, F.lit(0))
        named = F.zip_with(F.slice(said, F.lit(1), rest), F.slice(said, F.lit(2), rest), lambda before, v: F.when(v.rlike(BIRTH_LINE) & ~_holds(before, NOT_CARD_NAMES), before))
        found["full_name"].append(plain(first(F.filter(named, lambda v: v.isNotNull())), WITHOUT_LABEL[kind]))
        found["address"].append(plain(_trim(first(F.filter(lines, lambda v: _holds(v, ADDRESS_WORDS)))), ADDRESS_CONFIDENCE))
        gender = F.coalesce(*[F.when(t.rlike(p), g) for g, p in GENDERS])
        found["gender"] = [_item(gender, gender, F.coalesce(*[F.nullif(F.regexp_instr(t, F.lit(p)), F.lit(0)) for _, p in GENDERS]), GENDER_CONFIDENCE)]
    if kind == "SALARY_SLIP":
        found["employer_name"].append(plain(first(F.filter(said, lambda v: ~_holds(v, NOT_EMPLOYERS))), WITHOUT_LABEL[kind]))
    if kind == "BANK_STATEMENT":
        other = F.nullif(_trim(F.regexp_extract(t, HOLDER, 1)), F.lit(""))
        found["account_holder"].append(once(other, lambda v: F.when(~_holds(v, NOT_HOLDERS), _item(v, v, place(v), WITHOUT_LABEL[kind]))))
        # a bank's pattern is looked for only where its name is; the first that is there counts, with its place
        low = F.lower(t)
        at = [F.when(F.contains(low, F.lit(b.lower())), F.nullif(F.regexp_instr(t, F.lit(rf"(?i)\b{b}\b")), F.lit(0))) for b in x.BANKS]
        first_bank = F.coalesce(*[once(a, lambda v, b=b: F.when(v.isNotNull(), F.struct(F.lit(b).alias("bank"), v.alias("at")))) for a, b in zip(at, x.BANKS, strict=True)], F.struct(F.lit("Scheduled Commercial Bank").alias("bank"), F.lit(None).cast("int").alias("at")))
        found["bank_name"] = [once(first_bank, lambda v: _item(v["bank"], v["bank"], v["at"], BANK_CONFIDENCE))]
    if kind == "PROPERTY_DEED":
        kept = [F.nullif(_trim(F.regexp_replace(a["value"], ADDRESS_ENDS, "")), F.lit("")) for a in found["property_address"]]
        found["property_address"] = [_item(v, v, a["start"], RULES[kind][2][1]) for a, v in zip(found["property_address"], kept, strict=True)]
    return {name: F.coalesce(*items) if len(items) > 1 else items[0] for name, items in found.items()}


def bounces(t: Column, lines: Column) -> Column:
    """How many payments a statement says were returned, or the lines that tell of one."""
    stated = F.regexp_extract(t, RETURNS, 1).try_cast("int")
    up = lambda v, words: reduce(lambda a, b: a | b, (F.contains(F.upper(v), F.lit(w)) for w in words))
    return F.coalesce(stated, F.size(F.filter(lines, lambda v: up(v, x.BOUNCE) & ~up(v, NO_RETURNS))))


def pays_salary(lines: Column) -> Column:
    """Whether a statement's lines have a salary credit: an amount above zero in a line that says so, or where a named
    credit's line or the first amount of one of the five after it is."""
    said = F.filter(F.transform(lines, _trim), lambda v: v != "")
    amount = lambda v: F.regexp_replace(v, ",", "").try_cast("double")
    all_ = lambda v: F.transform(F.regexp_extract_all(v, F.lit(x.AMOUNT), F.lit(1)), amount)
    up = lambda v, words: reduce(lambda a, b: a | b, (F.contains(v, F.lit(w)) for w in words))
    # only lines of which one says salary, and the five after them, need their amounts
    read = lambda v, i: F.struct(i.alias("i"), v.alias("said"), F.upper(v).alias("up"))
    paid = lambda v: F.coalesce(F.get(all_(v["said"]), F.lit(0)) > 0, F.lit(False))

    def pays(lines):
        in_line = F.exists(lines, lambda v: up(v["up"], x.SALARY) & F.exists(all_(v["said"]), lambda a: a > 0))
        named = F.filter(lines, lambda v: up(v["up"], x.SALARY_LINE))
        return in_line | F.exists(named, lambda n: F.exists(F.slice(lines, n["i"] + 1, F.lit(6)), paid))

    return once(F.transform(said, read), pays)


def extracted(docs: DataFrame, kind: str, *keys: str, text: str = "text") -> DataFrame:
    """keys, the typed fields of documents of one class, is_valid where the class has a rule for it, and provenance: an
    array of (field, value, snippet, start, confidence) with one element for each field found. start is where the match that
    gives the value begins, from 1; null for values that are worked out and don't stand in the text. A null text is empty."""
    keys = keys or ("application_id",)
    t, c = F.col("_t"), F.col
    df = docs.select(*keys, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_lines", F.split("_t", "\n"))
    found = _shown(t, c("_lines"), kind)
    df = df.select(*keys, "_t", "_lines", *[v.alias(f"_{n}") for n, v in found.items()], *[v.alias(n) for n, v in _plain(t, kind).items()])
    names = [*found]
    columns = {n: c(f"_{n}.value") for n in names}
    shown = {n: c(f"_{n}") for n in names}
    if kind == "PAN_CARD":
        columns["entity_type"] = F.when(columns["pan_number"].isNull(), "Individual").otherwise(lookup(F.substring(columns["pan_number"], 4, 1), x.ENTITIES, "Other / Unknown"))
        columns["is_valid"] = columns["pan_number"].isNotNull()
    if kind == "AADHAAR_CARD":
        columns["aadhaar_number"] = F.regexp_replace(columns["aadhaar_number"], " ", "-")
        columns["is_masked"] = F.coalesce(F.contains(F.upper(columns["aadhaar_number"]), F.lit("X")), F.lit(True))
        columns["is_valid"] = F.coalesce(F.char_length(F.regexp_replace(columns["aadhaar_number"], "[- ]", "")) == 12, F.lit(False))
        where = F.regexp_replace(columns["address"], "\n", " ")
        labelled = c("_address.confidence") > ADDRESS_CONFIDENCE
        pin = columns["pincode"]
        columns["address"] = F.when(labelled & pin.isNotNull() & ~F.contains(where, pin), F.concat(where, F.lit(", PIN: "), pin)).otherwise(F.when(labelled, where).otherwise(columns["address"]))
        shown["address"] = F.when(shown["address"].isNotNull(), shown["address"].withField("value", columns["address"]))
        shown["aadhaar_number"] = F.when(shown["aadhaar_number"].isNotNull(), shown["aadhaar_number"].withField("value", columns["aadhaar_number"]))
    if kind == "FORM_16":
        for n in ("assessment_year", "financial_year"):
            columns[n] = F.regexp_replace(columns[n], " ", "")
            shown[n] = F.when(shown[n].isNotNull(), shown[n].withField("value", columns[n]))
        columns["is_valid"] = columns["employer_tan"].isNotNull() & columns["employee_pan"].isNotNull() & (c("gross_salary") > 0)
    if kind == "SALARY_SLIP":
        usable = (c("gross_salary") > 0) & (c("net_salary") > 0)
        columns["is_valid"] = usable & (F.abs(c("gross_salary") - c("total_deductions") - c("net_salary")) <= 1.0)
    if kind == "BANK_STATEMENT":
        columns["bounce_count"] = bounces(t, c("_lines"))
        money = (c("average_balance") > 0) | (c("closing_balance") > 0) | pays_salary(c("_lines"))
        columns["is_valid"] = columns["account_number"].isNotNull() & columns["ifsc_code"].isNotNull() & money
    if kind == "PROPERTY_DEED":
        parts = F.filter(F.transform(F.split(columns["property_address"], ","), _trim), lambda v: v != "")
        at = F.array_position(F.transform(parts, F.lower), F.lower(c("city")))
        columns["locality"] = F.when(at > 1, F.get(parts, (at - 2).cast("int")))
        for n, v, snippet, confidence in (
            ("document_title", c("title"), c("title"), TITLE_CONFIDENCE),
            ("super_area", c("super_area").cast("string"), F.concat(c("super_area").cast("string"), F.lit(" Sq. Ft.")), AREA_CONFIDENCE),
            ("locality", columns["locality"], columns["locality"], LOCALITY_CONFIDENCE),
        ):
            shown[n] = _item(v, snippet, F.nullif(F.position(v, t), F.lit(0)), confidence)
    for n, confidence, label in SHOWN.get(kind, ()):
        shown[n] = F.when(c(n) > 0, _item(F.format_number(c(n), 2), F.concat(F.lit(label), F.format_number(c(n), 2)), F.regexp_instr(t, F.lit(x.AMOUNTS[kind][n])), confidence))
    each = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), *[v[k].alias(k) for k in ("value", "snippet", "start", "confidence")])) for n, v in shown.items()]
    columns["provenance"] = F.filter(F.array(*each), lambda v: v.isNotNull())
    return df.select(*keys, *[v.alias(n) for n, v in columns.items()], *[n for n in _plain(t, kind) if n not in columns])


def _plain(t: Column, kind: str) -> dict[str, Column]:
    """The amounts of a class, and of deeds what follows from their whole text."""
    out = {n: x.amount(t, p) if kind == "PROPERTY_DEED" else F.coalesce(x.amount(t, p), F.lit(0.0)) for n, p in x.AMOUNTS.get(kind, {}).items()}
    if kind == "PROPERTY_DEED":
        out["title"] = F.when(t.rlike(r"(?i)Allotment\s+Letter"), "Allotment Letter").when(t.rlike(r"(?i)Possession\s+(?:Certificate|Letter)"), "Possession Certificate").when(t.rlike(r"(?i)Agreement\s+for\s+Sale"), "Agreement for Sale").otherwise("Sale Deed")
        out["city"] = F.coalesce(*[F.when(t.rlike(rf"(?i)\b{v}\b"), v) for v in x.CITIES])
    return out


def provenance(docs: DataFrame, *keys: str, kind: str = "doc_class") -> DataFrame:
    """keys, doc_class, field, value, snippet, start, confidence: a row for each field found in classified documents.
    Each class is a projection of its own over the documents of that class."""
    keys = keys or ("application_id",)
    parts = []
    for k in x.CLASSES:
        found = extracted(docs.where(F.col(kind) == k), k, *keys)
        # of inline() the optimizer infers a filter on the array, which would work out all fields once more
        parts.append(found.select(*keys, F.lit(k).alias("doc_class"), F.inline_outer("provenance")).where("field is not null"))
    return reduce(DataFrame.unionByName, parts)
