"""Queries of extracted fields with their provenance, and their SQL from the same fixed patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.operators import documents as x
from loanloom.operators import provenance as p
from loanloom.plans.documents import _BANK, _CITY, _TITLE, _amount, q

KEYS = ("application_id", "filename")


def read_texts(s, d):
    """The texts of both views under their classes."""
    typed = view(s, d, "doc_texts").where("true_type <> 'OTHER'").select("application_id", "filename", F.col("true_type").alias("doc_class"), "text")
    return typed.unionByName(view(s, d, "scanned_texts").select("application_id", "filename", "doc_class", "text"))


@once
def d14_provenance(s, d):
    return p.provenance(read_texts(s, d), *KEYS)


def d14_confidence_by_field(s, d):
    """How often each field is found, how sure its extraction is, and how often it had no label."""
    found = d14_provenance(s, d)
    least = F.min("confidence")
    return found.groupBy("doc_class", "field").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), least.alias("least"), F.count_if(F.col("start").isNull()).alias("n_not_in_text"))


def _typed(kind):
    def run(s, d):
        return p.extracted(read_texts(s, d).where(F.col("doc_class") == kind), kind, *KEYS).drop("provenance")

    return run


QUERIES = {"d14_provenance": d14_provenance, "d14_confidence_by_field": d14_confidence_by_field} | {
    "d02_pan_fields": _typed("PAN_CARD"), "d03_aadhaar_fields": _typed("AADHAAR_CARD"), "d07_statement_fields": _typed("BANK_STATEMENT"), "d10_deed_fields": _typed("PROPERTY_DEED"),
}

_WHITE = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _trim(v):
    return f"trim({v}, {_WHITE})"


def _holds(v, words):
    return "(" + " OR ".join(f"contains(lower({v}), {q(w)})" for w in words) + ")"


def _start(pattern):
    return f"length(regexp_extract(t, {q('^((?s:.*?))(?:' + pattern + ')')}, 1)) + 1"


def _item(value, snippet, start, confidence):
    return f"CASE WHEN {value} IS NOT NULL THEN {{'value': {value}, 'snippet': {snippet}, 'start': CAST({start} AS INT), 'confidence': {confidence}::DOUBLE}} END"


def _matched(pattern, confidence, shows):
    value = f"nullif({_trim(f'regexp_extract(t, {q(pattern)}, 1)')}, '')"
    whole = f"regexp_extract(t, {q(pattern)}, 0)"
    return _item(value, {"match": whole, "trimmed": _trim(whole), "value": value}[shows], _start(pattern), confidence)


def _plain(value, confidence):
    return _item(value, value, f"nullif(strpos(t, {value}), 0)", confidence)


def _found(kind):
    """SQL of the found fields of a class over t, lines and said (trimmed lines that aren't empty)."""
    found = {name: [_matched(pattern, confidence, shows) for pattern in patterns] for name, confidence, shows, patterns in p.RULES[kind]}
    sure = p.WITHOUT_LABEL.get(kind)
    if kind == "PAN_CARD":
        found["full_name"].append(_plain(f"[v for v in said if NOT {_holds('v', p.NOT_PAN_NAMES)}][1]", sure))
    if kind == "AADHAAR_CARD":
        found["full_name"].append(_plain(f"[said[i - 1] for i in range(2, len(said) + 1) if regexp_matches(said[i], {q(p.BIRTH_LINE)}) AND NOT {_holds('said[i - 1]', p.NOT_CARD_NAMES)}][1]", sure))
        found["address"].append(_plain(_trim(f"[v for v in lines if {_holds('v', p.ADDRESS_WORDS)}][1]"), p.ADDRESS_CONFIDENCE))
        gender = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(g)}) THEN '{n}'" for n, g in p.GENDERS) + " END"
        start = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(g)}) THEN {_start(g)}" for _, g in p.GENDERS) + " END"
        found["gender"] = [_item(gender, gender, start, p.GENDER_CONFIDENCE)]
    if kind == "SALARY_SLIP":
        found["employer_name"].append(_plain(f"[v for v in said if NOT {_holds('v', p.NOT_EMPLOYERS)}][1]", sure))
    if kind == "BANK_STATEMENT":
        other = f"nullif({_trim(f'regexp_extract(t, {q(p.HOLDER)}, 1)')}, '')"
        found["account_holder"].append(f"CASE WHEN NOT {_holds(other, p.NOT_HOLDERS)} THEN {_plain(other, sure)} END")
        known = [rf"(?i)\b{b}\b" for b in x.BANKS]
        start = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(b)}) THEN {_start(b)}" for b in known) + " END"
        found["bank_name"] = [_item(_BANK, _BANK, start, p.BANK_CONFIDENCE)]
    if kind == "PROPERTY_DEED":
        out = []
        for pattern in p.RULES[kind][2][3]:
            value = f"nullif({_trim(f'regexp_replace(nullif({_trim(f"regexp_extract(t, {q(pattern)}, 1)")}, $$$$), {q(p.ADDRESS_ENDS)}, $$$$)')}, '')"
            out.append(_item(value, value, _start(pattern), p.RULES[kind][2][1]))
        found["property_address"] = out
    return {name: f"coalesce({', '.join(items)})" if len(items) > 1 else items[0] for name, items in found.items()}


def _numbers(kind):
    return {n: _amount(e) if kind == "PROPERTY_DEED" else f"coalesce({_amount(e)}, 0)" for n, e in x.AMOUNTS.get(kind, {}).items()}


_TEXTS = """SELECT application_id, filename, true_type AS doc_class, text FROM doc_texts WHERE true_type <> 'OTHER' UNION ALL SELECT application_id, filename, doc_class, text FROM scanned_texts"""


def _first(kind):
    """The found fields of a class, one struct each, with its amounts."""
    columns = [f"{e} AS f_{n}" for n, e in _found(kind).items()] + [f"{e} AS {n}" for n, e in _numbers(kind).items()]
    if kind == "PROPERTY_DEED":
        columns += [f"{_TITLE} AS title", f"{_CITY} AS city"]
    lines = f"SELECT application_id, filename, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines, [{_trim('v')} for v in string_split(coalesce(text, ''), chr(10)) if {_trim('v')} <> ''] AS said FROM texts WHERE doc_class = '{kind}'"
    return f"SELECT application_id, filename, t, lines, said, {', '.join(columns)} FROM ({lines})"


_ADDRESS = f"CASE WHEN f_address.confidence > {p.ADDRESS_CONFIDENCE} THEN replace(f_address.value, chr(10), ' ') || CASE WHEN f_pincode.value IS NOT NULL AND NOT contains(replace(f_address.value, chr(10), ' '), f_pincode.value) THEN ', PIN: ' || f_pincode.value ELSE '' END ELSE f_address.value END"
_NUMBER = "replace(f_aadhaar_number.value, ' ', '-')"
_PARTS = f"[{_trim('v')} for v in string_split(f_property_address.value, ',') if {_trim('v')} <> '']"
_AT = f"list_position([lower(v) for v in {_PARTS}], lower(city))"
_LOCALITY = f"CASE WHEN {_AT} > 1 THEN ({_PARTS})[{_AT} - 1] END"
_VALUES = {"AADHAAR_CARD": {"address": _ADDRESS, "aadhaar_number": _NUMBER}, "FORM_16": {n: f"replace(f_{n}.value, ' ', '')" for n in ("assessment_year", "financial_year")}}


def _rows(kind):
    """A row for each found field of a class."""
    parts = []
    for n in _found(kind):
        value = _VALUES.get(kind, {}).get(n, f"f_{n}.value")
        parts.append(f"CASE WHEN f_{n} IS NOT NULL THEN {{'field': '{n}', 'value': {value}, 'snippet': f_{n}.snippet, 'start': f_{n}.start, 'confidence': f_{n}.confidence}} END")
    if kind == "PROPERTY_DEED":
        for n, v, snippet, confidence in (("document_title", "title", "title", p.TITLE_CONFIDENCE), ("super_area", "CAST(super_area AS VARCHAR)", "CAST(super_area AS VARCHAR) || ' Sq. Ft.'", p.AREA_CONFIDENCE), ("locality", _LOCALITY, _LOCALITY, p.LOCALITY_CONFIDENCE)):
            parts.append(f"CASE WHEN {v} IS NOT NULL THEN {{'field': '{n}', 'value': {v}, 'snippet': {snippet}, 'start': CAST(nullif(strpos(t, {v}), 0) AS INT), 'confidence': {confidence}::DOUBLE}} END")
    for n, confidence, label in p.SHOWN.get(kind, ()):
        said = f"format('{{:,.2f}}', {n})"
        parts.append(f"CASE WHEN {n} > 0 THEN {{'field': '{n}', 'value': {said}, 'snippet': '{label}' || {said}, 'start': CAST({_start(x.AMOUNTS[kind][n])} AS INT), 'confidence': {confidence}::DOUBLE}} END")
    return f"SELECT application_id, filename, '{kind}' AS doc_class, i.field AS field, i.value AS value, i.snippet AS snippet, i.start AS start, i.confidence AS confidence FROM (SELECT application_id, filename, unnest([v for v in [{', '.join(parts)}] if v IS NOT NULL]) AS i FROM ({_first(kind)}))"


def _up(v, words):
    return "(" + " OR ".join(f"contains(upper({v}), {q(w)})" for w in words) + ")"


_BOUNCES = f"coalesce(TRY_CAST(regexp_extract(t, {q(p.RETURNS)}, 1) AS INT), len([v for v in lines if {_up('v', x.BOUNCE)} AND NOT {_up('v', p.NO_RETURNS)}]))"
def _all(v):
    return f"[CAST(replace(a, ',', '') AS DOUBLE) for a in regexp_extract_all({v}, {q(x.AMOUNT)}, 1)]"


_PAYS = f"""(len([v for v in said if {_up('v', x.SALARY)} AND len([a for a in {_all('v')} if a > 0]) > 0]) > 0
 OR len([i for i in range(1, len(said) + 1) if {_up('said[i]', x.SALARY_LINE)} AND len([j for j in range(i, least(i + 5, len(said)) + 1) if coalesce(({_all('said[j]')})[1] > 0, false)]) > 0]) > 0)"""
_VALID = {
    "PAN_CARD": "f_pan_number IS NOT NULL",
    "AADHAAR_CARD": f"coalesce(length(regexp_replace({_NUMBER}, '[- ]', '', 'g')) = 12, false)",
    "BANK_STATEMENT": f"f_account_number IS NOT NULL AND f_ifsc_code IS NOT NULL AND ({_PAYS} OR average_balance > 0 OR closing_balance > 0)",
}
_ENTITY = "CASE WHEN f_pan_number IS NULL THEN 'Individual' ELSE CASE substring(f_pan_number.value, 4, 1) " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in x.ENTITIES.items()) + " ELSE 'Other / Unknown' END END"


def _fields(kind):
    columns = [f"{_VALUES.get(kind, {}).get(n, f'f_{n}.value')} AS {n}" for n in _found(kind)] + list(_numbers(kind))
    columns += [f"{_VALID[kind]} AS is_valid"] if kind in _VALID else []
    columns += {
        "PAN_CARD": [f"{_ENTITY} AS entity_type"], "AADHAAR_CARD": [f"coalesce(contains(upper({_NUMBER}), 'X'), true) AS is_masked"],
        "BANK_STATEMENT": [f"{_BOUNCES} AS bounce_count"], "PROPERTY_DEED": ["title", "city", f"{_LOCALITY} AS locality"],
    }[kind]
    return f"SELECT application_id, filename, {', '.join(columns)} FROM ({_first(kind)})"


def _o(sql):
    return oracle(sql, "doc_texts", "scanned_texts", texts=_TEXTS)


PROVENANCE_SQL = " UNION ALL ".join(_rows(kind) for kind in x.CLASSES)
ORACLE = {
    "d14_provenance": _o(f"SELECT * FROM ({PROVENANCE_SQL})"),
    "d14_confidence_by_field": _o(f"SELECT doc_class, field, count(*) AS n, round(avg(confidence), 4) AS confidence, min(confidence) AS least, count(*) FILTER (WHERE start IS NULL) AS n_not_in_text FROM ({PROVENANCE_SQL}) GROUP BY 1, 2"),
    "d02_pan_fields": _o(_fields("PAN_CARD")), "d03_aadhaar_fields": _o(_fields("AADHAAR_CARD")), "d07_statement_fields": _o(_fields("BANK_STATEMENT")), "d10_deed_fields": _o(_fields("PROPERTY_DEED")),
}
