"""Queries of document texts, and their SQL from the same fixed words and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.operators import documents as x
from loanloom.operators import ingestion, pages, profiles
from loanloom.plans.sql import edits, r

AS_OF = "2024-06-30"


def texts(s, d, kind):
    return view(s, d, "doc_texts").where(F.col("true_type") == kind)


def d01_classified(s, d):
    return x.classified(view(s, d, "doc_texts")).select("application_id", "true_type", "doc_class", "class_confidence")


def t03_class_counts(s, d):
    return x.classified(view(s, d, "doc_texts")).groupBy("true_type", "doc_class").agg(F.count("*").alias("n"))


def _fields(kind):
    return lambda s, d: x.fields(texts(s, d, kind), kind)


def d04_salary_slip(s, d):
    items = lambda c: F.array_join(F.transform(c, lambda i: F.concat(i["component"], F.lit("="), F.format_string("%.2f", i["amount"]))), "; ").alias(c)
    found = x.fields(texts(s, d, "SALARY_SLIP"), "SALARY_SLIP")
    return found.withColumns({"earnings": items("earnings"), "deductions": items("deductions")})


def coverage(s, d):
    return x.coverage(texts(s, d, "BANK_STATEMENT"), "BANK_STATEMENT")


def d08_transactions(s, d):
    return x.transactions(texts(s, d, "BANK_STATEMENT")).select("application_id", "category", "amount")


def d09_statement_summary(s, d):
    return x.statement_summary(x.transactions(texts(s, d, "BANK_STATEMENT")))


@once
def slips(s, d):
    return x.fields(texts(s, d, "SALARY_SLIP"), "SALARY_SLIP")


def d11_overridden(s, d):
    """Reviewers' corrections of every seventh slip, one of them of a field that can't be edited."""
    c = F.col
    some = slips(s, d).where("application_id % 7 = 0").select("application_id", "gross_salary")
    fixes = some.select("application_id", F.inline(F.array(F.struct(F.lit("net_salary").alias("field"), (c("gross_salary") - 1).cast("string").alias("value")), F.struct(F.lit("employee_id").alias("field"), F.lit("E1").alias("value")))))
    found = x.overridden(slips(s, d).select("application_id", "gross_salary", "net_salary", "employee_name"), fixes, "application_id", ("net_salary", "employee_name"))
    return found.withColumn("invalid_fields", F.array_join("invalid_fields", ","))


def d12_bundles(s, d):
    found = x.bundled(x.classified(view(s, d, "doc_texts")).withColumn("place", F.crc32(F.encode("filename", "UTF-8"))), "application_id", "place")
    return found.select("application_id", F.size("slips").alias("n_slips"), *[F.char_length(k).alias(k) for k in ("pan_card", "aadhaar_card", "bank_statement", "property_deed")])


def w08_first_slip(s, d):
    return slips(s, d).groupBy("employee_name").agg(F.min_by("employee_id", F.col("application_id")).alias("first_id"), F.count("*").alias("n"))


def v05_recency(s, d):
    c = F.col
    return slips(s, d).select("application_id", x.month(c("month_year")).cast("string").alias("month"), x.recency(c("month_year"), AS_OF).alias("status"))


def v06_years(s, d):
    found = x.fields(texts(s, d, "FORM_16"), "FORM_16")
    return found.select("application_id", x.years_agree(F.col("assessment_year"), F.col("financial_year")).alias("years_agree"))


LABELS = (*x.CLASSES, "UNKNOWN")


def called(s, d):
    """How often documents of each class are called each."""
    return classes(s, d).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@once
def classes(s, d):
    return x.classified(view(s, d, "doc_texts")).select(F.when(F.col("true_type") == "OTHER", "UNKNOWN").otherwise(F.col("true_type")).alias("actual"), F.col("doc_class").alias("predicted"))


def a32_class_report(s, d):
    return ingestion.class_report(called(s, d), LABELS, "n")


def a32_class_summary(s, d):
    return ingestion.class_summary(called(s, d), LABELS, "n")


def a33_class_cost(s, d):
    return ingestion.class_cost(called(s, d), "n")


def truths(s, d):
    """Extracted slip fields against what the applications say."""
    known = view(s, d, "applications").select("application_id", "name", "monthly_income")
    return slips(s, d).join(known, "application_id").select(F.inline(F.array(
        F.struct(F.lit("employee_name").alias("field"), F.col("name").alias("truth"), F.col("employee_name").alias("found")),
        F.struct(F.lit("gross_salary").alias("field"), F.col("monthly_income").cast("string").alias("truth"), F.col("gross_salary").cast("string").alias("found")),
        F.struct(F.lit("month").alias("field"), F.lit("May 2024").alias("truth"), F.col("month_year").alias("found")))))


def a39_field_quality(s, d):
    return ingestion.field_quality(truths(s, d), ("gross_salary",))


def a40_text_errors(s, d):
    """Each turn of a conversation against the one before it: short texts of real length."""
    turns = view(s, d, "conversations").where("turn <= 1").select("conv_id", "turn", F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("text"))
    pairs = turns.groupBy("conv_id").agg(F.max_by("text", -F.col("turn")).alias("reference"), F.max_by("text", "turn").alias("predicted"))
    return ingestion.text_errors(pairs.withColumn("source", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")), "reference", "predicted", "source")


@once
def profiled(s, d):
    return profiles.profiles(x.classified(view(s, d, "doc_texts")))


def d13_profiles(s, d):
    return profiled(s, d).select("application_id", "primary_name", "pan_number", "aadhaar_number", "monthly_gross", "monthly_net", "n_slips", "property_city", "verification_status", "n_missing", "flags")


def k10_compliance_input(s, d):
    return profiled(s, d).select("application_id", "pan_present", "aadhaar_present", "address_present", "source_of_funds_declared", "identity_verification_logged")


def d15_structured(s, d):
    return pages.structured(view(s, d, "listing_pages"))


def d16_attributes(s, d):
    return pages.attributes(view(s, d, "listing_pages"))


#: Paths that the queries read of the merged data.
MERGED = {"name": "$.name", "locality": "$.address.addressLocality", "pincode": "$.address.postalCode", "price": "$.offers.price", "city": "$.props.page.city", "page": "$.props.page.id", "lat": "$.geo.lat", "lon": "$.geo.lon", "x": "$.geo.at.x", "y": "$.geo.at.y", "tag": "$.tags[0]", "tagged": "$.tags.k"}


def d15_deep_merged(s, d):
    found = pages.merged_data(view(s, d, "rich_pages"))
    return found.select("page_id", "n_chunks", F.array_join(F.array_sort(F.json_object_keys("data")), ",").alias("keys"), *[F.get_json_object("data", p).alias(n) for n, p in MERGED.items()])


def d16_configurations(s, d):
    return pages.configurations(view(s, d, "rich_pages"))


def d16_localities(s, d):
    return pages.localities(view(s, d, "rich_pages"))


def d17_projects(s, d):
    return pages.projects(view(s, d, "listing_pages"))


QUERIES = {
    "d02_pan_card": _fields("PAN_CARD"), "d03_aadhaar": _fields("AADHAAR_CARD"), "d05_form_16": _fields("FORM_16"), "d06_itr": _fields("ITR"), "d07_bank_statement": _fields("BANK_STATEMENT"), "d10_property_deed": _fields("PROPERTY_DEED"),
    "d07_field_coverage": coverage,
} | {
    f.__name__: f
    for f in (d01_classified, t03_class_counts, d04_salary_slip, d08_transactions, d09_statement_summary, d11_overridden, d12_bundles, w08_first_slip, v05_recency, v06_years,
              a32_class_report, a32_class_summary, a33_class_cost, a39_field_quality, a40_text_errors, d13_profiles, k10_compliance_input, d15_structured, d16_attributes, d15_deep_merged, d16_configurations, d16_localities, d17_projects)
}


def q(text):
    return "'" + text.replace("'", "''") + "'"


def _first(patterns):
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(t, {q(p)}, 1), chr(32) || chr(9) || chr(10) || chr(13)), '')" for p in patterns) + ")"


def _amount(pattern):
    return f"TRY_CAST(replace(regexp_extract(t, {q(pattern)}, 1), ',', '') AS DOUBLE)"


def _any(column, parts):
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in parts) + ")"


def _score(kind):
    boost, parts = x.FILE_PARTS[kind]
    terms = [f"CASE WHEN {_any('lower(filename)', parts)} THEN {boost} ELSE 0 END"] + [f"CASE WHEN contains(lower(t), {q(w)}) THEN {v} ELSE 0 END" for w, v in x.WORDS[kind].items()] + [f"CASE WHEN regexp_matches(t, {q(p)}) THEN 2.5 ELSE 0 END" for p in x.ANCHORS[kind]]
    return "(" + " + ".join(terms) + ")::DOUBLE"


_LIST = "[" + ", ".join(f"s{k}" for k in range(len(x.CLASSES))) + "]"
CLASSIFIED_SQL = f"""SELECT application_id, true_type, filename, text, CASE WHEN best < 2 THEN 'UNKNOWN' ELSE ([{", ".join(q(c) for c in x.CLASSES)}])[list_position({_LIST}, best)] END AS doc_class, CASE WHEN best < 2 THEN 0.3::DOUBLE ELSE {r("least(0.99::DOUBLE, greatest(0.6::DOUBLE, 0.5::DOUBLE + best / 25))", 3)} END AS class_confidence FROM (
 SELECT *, list_max({_LIST}) AS best FROM (SELECT *, {", ".join(f"{_score(kind)} AS s{k}" for k, kind in enumerate(x.CLASSES))} FROM (SELECT *, coalesce(text, '') AS t FROM doc_texts)))"""


def _columns(kind):
    out = {n: _first(p) for n, p in x.TEXTS[kind].items()}
    out |= {n: _amount(p) if kind == "PROPERTY_DEED" else f"coalesce({_amount(p)}, 0)" for n, p in x.AMOUNTS.get(kind, {}).items()}
    for n in ("assessment_year", "financial_year"):
        if n in out:
            out[n] = f"replace({out[n]}, ' ', '')"
    return out


def _typed(kind, more, where=None):
    return f"SELECT application_id, {', '.join(f'{e} AS {n}' for n, e in (_columns(kind) | more).items())} FROM (SELECT *, coalesce(text, '') AS t FROM doc_texts WHERE true_type = '{kind}')"


_ENTITY = "CASE substring({0}, 4, 1) ".format(_first(x.TEXTS["PAN_CARD"]["pan_number"])) + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in x.ENTITIES.items()) + " ELSE 'Other / Unknown' END"
_NUMBER = f"replace({_first(x.TEXTS['AADHAAR_CARD']['aadhaar_number'])}, ' ', '-')"


def _parts(table):
    return "list_filter([" + ", ".join(f"{{'c': {q(n)}, 'a': {_amount(p + x._MONEY)}}}" for n, p in table.items()) + "], lambda i: i.a > 0)"


def _said(table):
    return f"array_to_string([i.c || '=' || printf('%.2f', i.a) for i in {_parts(table)}], '; ')"


_G, _N = (f"coalesce({_amount(x.AMOUNTS['SALARY_SLIP'][n])}, 0)" for n in ("gross_salary", "net_salary"))
_T = f"CASE WHEN coalesce({_amount(x.AMOUNTS['SALARY_SLIP']['total_deductions'])}, 0) = 0 THEN coalesce(list_sum([i.a for i in {_parts(x.DEDUCTIONS)}]), 0) ELSE {_amount(x.AMOUNTS['SALARY_SLIP']['total_deductions'])} END"
SLIPS_SQL = _typed("SALARY_SLIP", {"earnings": _said(x.EARNINGS), "deductions": _said(x.DEDUCTIONS), "total_deductions": _T, "adds_up": f"{_G} > 0 AND {_N} > 0 AND abs({_G} - {_T} - {_N}) <= 1"})
_BANK = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, {q(chr(40) + '?i)' + chr(92) + 'b' + b + chr(92) + 'b')}) THEN {q(b)} END" for b in x.BANKS) + ", 'Scheduled Commercial Bank')"
_CITY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, {q(chr(40) + '?i)' + chr(92) + 'b' + c + chr(92) + 'b')}) THEN {q(c)} END" for c in x.CITIES) + ")"
_TITLE = "CASE WHEN regexp_matches(t, '(?i)Allotment\\s+Letter') THEN 'Allotment Letter' WHEN regexp_matches(t, '(?i)Possession\\s+(?:Certificate|Letter)') THEN 'Possession Certificate' WHEN regexp_matches(t, '(?i)Agreement\\s+for\\s+Sale') THEN 'Agreement for Sale' ELSE 'Sale Deed' END"
_DEED = {n: _amount(p) for n, p in x.AMOUNTS["PROPERTY_DEED"].items()}
_KIND = f"CASE WHEN {_DEED['plot_area']} IS NOT NULL OR (regexp_matches(t, '(?i)Property\\s*Type:\\s*\\n?\\s*(?:Residential\\s+)?(?:Plot|Land)\\b') AND {_DEED['super_area']} IS NULL) THEN 'Residential Plot' ELSE 'Residential Flat' END"
_ADDRESS = f"[trim(p) for p in string_split({_first(x.TEXTS['PROPERTY_DEED']['property_address'])}, ',') if trim(p) <> '']"
_AT = f"list_position([lower(p) for p in {_ADDRESS}], lower({_CITY}))"
_LINES = "SELECT application_id, generate_subscripts(l, 1) AS line, unnest(l) AS said FROM (SELECT application_id, [trim(p) for p in string_split(text, chr(10)) if trim(p) <> ''] AS l FROM doc_texts WHERE true_type = 'BANK_STATEMENT')"
_AMOUNTS = f"[CAST(replace(a, ',', '') AS DOUBLE) for a in regexp_extract_all(said, {q(x.AMOUNT)}, 1) if CAST(replace(a, ',', '') AS DOUBLE) > 0]"
_LEADING = f"CAST(replace(regexp_extract_all(said, {q(x.AMOUNT)}, 1)[1], ',', '') AS DOUBLE)"
_TAGGED = f"""SELECT application_id, line, CASE WHEN credit IS NOT NULL OR (NOT has AND named AND ahead IS NOT NULL) THEN 'SALARY' WHEN NOT salary AND loan AND a[1] IS NOT NULL THEN 'LOAN_EMI' END AS category, CASE WHEN credit IS NOT NULL THEN credit WHEN NOT has AND named AND ahead IS NOT NULL THEN ahead ELSE a[1] END AS amount FROM (
 SELECT *, bool_or(credit IS NOT NULL) OVER (PARTITION BY application_id) AS has FROM (
 SELECT *, CASE WHEN salary THEN CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) >= 2 AND a[-1] > a[-2] * 1.2::DOUBLE THEN a[-2] ELSE a[1] END END AS credit, coalesce(z, {", ".join(f"lead(z, {k}) OVER (PARTITION BY application_id ORDER BY line)" for k in range(1, 6))}) AS ahead FROM (
 SELECT *, CASE WHEN {_LEADING} > 0 THEN {_LEADING} END AS z, {_any("upper(said)", x.SALARY)} AS salary, {_any("upper(said)", x.LOAN)} AS loan, {_any("upper(said)", x.SALARY_LINE)} AS named, {_AMOUNTS} AS a FROM lines)))"""
CHAIN = {"classified": CLASSIFIED_SQL, "slips": SLIPS_SQL, "lines": _LINES, "tagged": f"SELECT * FROM ({_TAGGED}) WHERE category IS NOT NULL"}


def _o(sql):
    return oracle(sql, "doc_texts", **CHAIN)


_MONTH = "coalesce(try_strptime(concat('1 ', regexp_replace(trim(month_year), '[-,]\\s*', ' ', 'g')), ['%d %B %Y', '%d %b %Y']), try_strptime(concat('1/', month_year), ['%d/%m/%Y']))"
_AGE = f"(2024 - year({_MONTH})) * 12 + 6 - month({_MONTH})"
_CLASSES = "SELECT CASE true_type WHEN 'OTHER' THEN 'UNKNOWN' ELSE true_type END AS actual, doc_class AS predicted FROM classified"
_CELLS = f"SELECT label, count(*) FILTER (WHERE actual = label) AS support, count(*) FILTER (WHERE predicted = label) AS called, count(*) FILTER (WHERE actual = label AND predicted = label) AS hit FROM (VALUES {', '.join(f'({q(c)})' for c in (*x.CLASSES, 'UNKNOWN'))}) v(label) CROSS JOIN ({_CLASSES}) GROUP BY 1"
_PQ = f"SELECT label, support, {r('coalesce(hit / nullif(called, 0)::DOUBLE, 0)', 4)} AS precision, {r('coalesce(hit / nullif(support, 0)::DOUBLE, 0)', 4)} AS recall FROM ({_CELLS})"
_REPORT = f"SELECT *, {r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)', 4)} AS f1 FROM ({_PQ})"
_COST = "CASE " + " ".join(f"WHEN actual = '{a}' AND predicted = '{b}' THEN {v}" for a, row in ingestion.CLASS_COSTS.items() for b, v in row.items()) + " ".join([""] + [f"WHEN actual = '{a}' THEN {row.get('OTHER', 5.0)}" for a, row in ingestion.CLASS_COSTS.items()]) + " WHEN actual = predicted THEN 0 ELSE 5 END"
_TRUTHS = "SELECT 'employee_name' AS field, name AS truth, employee_name AS found FROM slips JOIN applications USING (application_id) UNION ALL SELECT 'gross_salary', CAST(monthly_income AS VARCHAR), CAST(gross_salary AS VARCHAR) FROM slips JOIN applications USING (application_id) UNION ALL SELECT 'month', 'May 2024', month_year FROM slips"
_W = "[w for w in string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+') if w <> '']"
_F1 = r("CASE WHEN len(p) + len(q) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(list_sum([least(len([w for w in p if w = t]), len([w for w in q if w = t])) for t in list_distinct(q)]), 0) / (len(p) + len(q)) END", 4)
_SPLIT = "[w for w in string_split_regex(trim({}), '\\s+') if w <> '']"
_TURNS = "SELECT conv_id, arg_min(t, turn) AS a, arg_max(t, turn) AS b FROM (SELECT conv_id, turn, substring(coalesce(text, ''), 1, 60) AS t FROM conversations_of WHERE turn <= 1) GROUP BY 1"
def _last(kind, fields):
    columns = ", ".join(f"arg_max({n}, filename) AS {n}" for n in fields)
    typed = ", ".join(f"{_columns(kind)[n]} AS {n}" for n in fields)
    return f"SELECT application_id, {columns}, count(*) AS k FROM (SELECT application_id, filename, {typed} FROM (SELECT *, coalesce(text, '') AS t FROM classified WHERE doc_class = '{kind}')) GROUP BY 1"


_PROFILES = f"""SELECT n.application_id, coalesce(p.full_name, a.full_name, s.slip_name, 'Applicant') AS primary_name, p.pan_number, replace(a.aadhaar_number, ' ', '-') AS aadhaar_number, {r("coalesce(s.gross, f.gross_salary / 12.0::DOUBLE, 0)", 2)} AS monthly_gross, {r("coalesce(s.net, 0)", 2)} AS monthly_net, coalesce(s.n_slips, 0) AS n_slips, d.city AS property_city, 'verified' AS verification_status,
 CAST(p.pan_number IS NULL AS INT) + CAST(a.aadhaar_number IS NULL AS INT) + CAST(s.n_slips IS NULL AND f.gross_salary IS NULL AS INT) + CAST(b.account_number IS NULL AS INT) + CAST(d.property_address IS NULL AS INT) AS n_missing,
 p.pan_number IS NOT NULL AS pan_present, a.aadhaar_number IS NOT NULL AS aadhaar_present, a.address IS NOT NULL AS address_present, s.n_slips IS NOT NULL OR f.gross_salary IS NOT NULL OR b.account_number IS NOT NULL AS source_of_funds_declared
FROM (SELECT DISTINCT application_id FROM classified) n LEFT JOIN ({_last("PAN_CARD", ("full_name", "pan_number"))}) p ON p.application_id = n.application_id LEFT JOIN ({_last("AADHAAR_CARD", ("full_name", "aadhaar_number", "address"))}) a ON a.application_id = n.application_id
 LEFT JOIN ({_last("FORM_16", ("gross_salary",))}) f ON f.application_id = n.application_id LEFT JOIN ({_last("BANK_STATEMENT", ("account_number",))}) b ON b.application_id = n.application_id LEFT JOIN (SELECT application_id, arg_max(city, filename) AS city, arg_max(property_address, filename) AS property_address FROM (SELECT application_id, filename, {_CITY} AS city, {_first(x.TEXTS["PROPERTY_DEED"]["property_address"])} AS property_address FROM (SELECT *, coalesce(text, '') AS t FROM classified WHERE doc_class = 'PROPERTY_DEED')) GROUP BY 1) d ON d.application_id = n.application_id
 LEFT JOIN (SELECT application_id, count(*) AS n_slips, min({_columns("SALARY_SLIP")["employee_name"]}) AS slip_name, avg({_G}) AS gross, avg({_N}) AS net FROM (SELECT *, coalesce(text, '') AS t FROM classified WHERE doc_class = 'SALARY_SLIP') GROUP BY 1) s ON s.application_id = n.application_id"""
_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
_LD = f"regexp_extract_all(html, {q(pages.BLOCKS[0])}, 1)"
_NEXT = f"regexp_extract_all(html, {q(pages.BLOCKS[1])}, 1)"
_PRICE = f"lower(replace(regexp_extract(t, {q(pages.CONFIGURATION)}, 3), '₹', ''))"
_OBJECTS = """CASE WHEN CASE WHEN json_valid(b) THEN json_type(b) = 'ARRAY' ELSE false END THEN json_extract(b, '$[*]')::VARCHAR[] ELSE string_split(regexp_replace(b, '\\}\\s*\\{', '}' || chr(1) || '{', 'g'), chr(1)) END"""
_VALID_OBJECTS = "[x::JSON for x in {} if CASE WHEN json_valid(x) THEN json_type(x) = 'OBJECT' ELSE false END]"
_MERGED = f"""SELECT page_id, html, len([x for x in chunks if NOT starts_with(x, '7')]) AS n_chunks, list_reduce(list_concat(['{{}}'::JSON], {_VALID_OBJECTS.format('chunks')}, {_VALID_OBJECTS.format('nexts')}[1:1], {_VALID_OBJECTS.format('nuxts')}[1:1]), lambda p, q: json_merge_patch(p, q)) AS data FROM (
 SELECT page_id, html, flatten([{_OBJECTS} for b in regexp_extract_all(html, {q(pages.BLOCKS[0])}, 1)]) AS chunks, regexp_extract_all(html, {q(pages.BLOCKS[1])}, 1) AS nexts, regexp_extract_all(html, {q(pages.BLOCKS[2])}, 1) AS nuxts FROM rich_pages)"""
def _c(k):
    return f"regexp_extract_all(t, {q(pages.CONFIGURATION)}, {k})"


def _group(text, pattern):
    return f"nullif(trim(regexp_extract({text}, {q(pattern)}, 1)), '')"


_LINKS = f"flatten([regexp_extract_all(x, {q(pages.ANCHOR)}, 1) for x in list_concat(regexp_extract_all(html, {q(pages.CRUMBS)}, 1), regexp_extract_all(html, {q(pages.CRUMBS)}, 2))])"
_SAID = "trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
ORACLE = {
    "d15_deep_merged": oracle("SELECT page_id, n_chunks, array_to_string(list_sort(json_keys(data)), ',') AS keys, " + ", ".join(f"json_extract_string(data, '{p}') AS {n}" for n, p in MERGED.items()) + " FROM merged", "rich_pages", merged=_MERGED),
    "d16_configurations": oracle(f"""SELECT page_id, CAST(k AS INT) AS place, TRY_CAST(bhk AS INT) AS bedrooms, TRY_CAST(replace(area, ',', '') AS DOUBLE) AS area_sqft, TRY_CAST(regexp_extract(price, '[0-9.]+') AS DOUBLE) * CASE WHEN contains(price, 'cr') THEN 10000000 ELSE 100000 END AS price_inr
 FROM (SELECT page_id, unnest({_c(1)}) AS bhk, unnest({_c(2)}) AS area, lower(replace(replace(unnest({_c(3)}), '₹', ''), ',', '')) AS price, generate_subscripts({_c(1)}, 1) AS k FROM (SELECT page_id, {_TEXT} AS t FROM rich_pages))""", "rich_pages"),
    "d16_localities": oracle(f"""SELECT page_id, coalesce(known, described, linked, titled) AS locality, CASE WHEN known IS NOT NULL THEN 'data' WHEN described IS NOT NULL THEN 'description' WHEN linked IS NOT NULL THEN 'trail' WHEN titled IS NOT NULL THEN 'title' END AS found_in FROM (
 SELECT page_id, nullif(json_extract_string(data, '$.address.addressLocality'), '') AS known, {_group(f"regexp_extract(html, {q(pages.META)}, 1)", pages.IN_META)} AS described, [{_group(_SAID, pages.IN_CRUMB)} for x in {_LINKS} if {_group(_SAID, pages.IN_CRUMB)} IS NOT NULL][1] AS linked, {_group(f"regexp_extract(html, {q(pages.TITLE)}, 1)", pages.IN_TITLE)} AS titled FROM merged)""", "rich_pages", merged=_MERGED),
    "d13_profiles": _o(f"SELECT application_id, primary_name, pan_number, aadhaar_number, monthly_gross, monthly_net, n_slips, property_city, verification_status, n_missing, concat_ws(',', CASE WHEN n_missing > 0 THEN 'missing_documents' END, CASE WHEN NOT (pan_present AND aadhaar_present) THEN 'incomplete_kyc' END) AS flags FROM ({_PROFILES})"),
    "k10_compliance_input": _o(f"SELECT application_id, pan_present, aadhaar_present, address_present, source_of_funds_declared, pan_present AND aadhaar_present AS identity_verification_logged FROM ({_PROFILES})"),
    "d15_structured": oracle(f"SELECT page_id, len(b) AS n_blocks, " + ", ".join(f"list_filter([json_extract_string(j, '{p}') for j in b], lambda v: v IS NOT NULL)[-1] AS {n}" for n, p in pages.PATHS.items()) + f" FROM (SELECT page_id, list_concat({_LD}, {_NEXT}) AS b FROM listing_pages)", "listing_pages"),
    "d16_attributes": oracle(f"SELECT page_id, TRY_CAST(regexp_extract(t, {q(pages.CONFIGURATION)}, 1) AS INT) AS bedrooms, TRY_CAST(replace(regexp_extract(t, {q(pages.CONFIGURATION)}, 2), ',', '') AS DOUBLE) AS area_sqft, TRY_CAST(regexp_extract({_PRICE}, '[0-9.]+') AS DOUBLE) * 10000000 AS price_inr, nullif(regexp_extract(t, {q(pages.PIN)}, 1), '') AS pincode, CASE WHEN regexp_matches(t, '\\b[Ff]urnished\\b') THEN CASE WHEN regexp_matches(t, '\\b[Ss]emi[-\\s]?[Ff]urnished\\b') THEN 'Semi-Furnished' WHEN regexp_matches(t, '\\b[Uu]nfurnished\\b') THEN 'Unfurnished' ELSE 'Furnished' END END AS furnishing, " + ", ".join(f"TRY_CAST(regexp_extract(t, {q(p)}, 1) AS INT) AS {n}" for n, p in pages.ATTRIBUTES.items()) + f" FROM (SELECT page_id, {_TEXT} AS t FROM listing_pages)", "listing_pages"),
    "d17_projects": oracle(f"SELECT page_id, regexp_extract(html, {q(pages.PROJECT)}) AS rera_number, " + ", ".join((f"TRY_CAST(regexp_extract(html, {q(p)}, 1) AS INT)" if n in ("total_units", "area_sqft") else f"nullif(trim(regexp_extract(html, {q(p)}, 1)), '')") + f" AS {n}" for n, p in pages.PROJECT_FIELDS.items()) + f" FROM listing_pages WHERE regexp_matches(html, {q(pages.PROJECT)})", "listing_pages"),
    "d01_classified": _o("SELECT application_id, true_type, doc_class, class_confidence FROM classified"),
    "t03_class_counts": _o("SELECT true_type, doc_class, count(*) AS n FROM classified GROUP BY 1, 2"),
    "d02_pan_card": _o(_typed("PAN_CARD", {"entity_type": f"CASE WHEN {_first(x.TEXTS['PAN_CARD']['pan_number'])} IS NULL THEN 'Individual' ELSE {_ENTITY} END"})),
    "d03_aadhaar": _o(_typed("AADHAAR_CARD", {"aadhaar_number": _NUMBER, "is_masked": f"coalesce(contains(upper({_NUMBER}), 'X'), true)", "gender": "CASE WHEN regexp_matches(t, '(?i)\\b(?:MALE|PURUSH)\\b') THEN 'Male' WHEN regexp_matches(t, '(?i)\\b(?:FEMALE|MAHILA)\\b') THEN 'Female' WHEN regexp_matches(t, '(?i)\\bTRANSGENDER\\b') THEN 'Other' END"})),
    "d04_salary_slip": _o("SELECT * FROM slips"),
    "d05_form_16": _o(f"SELECT *, employer_tan IS NOT NULL AND employee_pan IS NOT NULL AND gross_salary > 0 AS is_valid FROM ({_typed('FORM_16', {})})"),
    "d06_itr": _o(_typed("ITR", {"form_type": f"coalesce(upper({_first(x.TEXTS['ITR']['form_type'])}), 'ITR-1')"})),
    "d07_bank_statement": _o(_typed("BANK_STATEMENT", {"bank_name": _BANK})),
    "d07_field_coverage": _o("SELECT 'BANK_STATEMENT' AS doc_class, n, field, coverage FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n, '{n}' AS field, {r(f'avg(CAST({n} IS NOT NULL AS INT))', 4)} AS coverage FROM ({_typed('BANK_STATEMENT', {})})" for n in x.TEXTS["BANK_STATEMENT"]) + ")"),
    "d08_transactions": _o("SELECT application_id, category, amount FROM tagged"),
    "d09_statement_summary": _o(f"SELECT application_id, count(*) FILTER (WHERE category = 'SALARY') AS n_credits, coalesce({r('avg(amount) FILTER (WHERE category = $$SALARY$$)', 2)}, 0) AS average_salary, {r('coalesce(sum(amount) FILTER (WHERE category = $$LOAN_EMI$$), 0) / greatest(count(*) FILTER (WHERE category = $$SALARY$$), 1)', 2)} AS monthly_obligations, greatest(count(*) FILTER (WHERE category = 'SALARY'), 6) AS months_covered FROM tagged GROUP BY 1"),
    "d10_property_deed": _o(_typed("PROPERTY_DEED", {"title": _TITLE, "city": _CITY, "property_type": _KIND, "carpet_area": f"coalesce({_DEED['carpet_area']}, {_DEED['plot_area']})", "locality": f"CASE WHEN {_AT} > 1 THEN ({_ADDRESS})[{_AT} - 1] END"})),
    "d11_overridden": _o("SELECT application_id, gross_salary, CASE WHEN application_id % 7 = 0 THEN gross_salary - 1 ELSE net_salary END AS net_salary, employee_name, CASE WHEN application_id % 7 = 0 THEN 'employee_id' ELSE '' END AS invalid_fields FROM slips"),
    "w08_first_slip": _o("SELECT employee_name, arg_min(employee_id, application_id) AS first_id, count(*) AS n FROM slips GROUP BY 1"),
    "v05_recency": _o(f"SELECT application_id, strftime({_MONTH}, '%Y-%m-%d') AS month, CASE WHEN coalesce(month_year, '') = '' THEN 'MISSING' WHEN {_MONTH} IS NULL THEN 'UNREADABLE' WHEN {_AGE} < 0 THEN 'FUTURE' WHEN {_AGE} > 3 THEN 'OLD' ELSE 'RECENT' END AS status FROM slips"),
    "v06_years": _o(f"SELECT application_id, coalesce(CAST(left(assessment_year, 4) AS INT) = CAST(left(financial_year, 4) AS INT) + 1, true) AS years_agree FROM ({_typed('FORM_16', {})})"),
    "a32_class_report": _o(_REPORT),
    "a32_class_summary": _o(f"SELECT n, {r('hits / n', 4)} AS accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE actual = predicted)::DOUBLE AS hits FROM ({_CLASSES})) CROSS JOIN (SELECT {r('avg(recall) FILTER (WHERE support > 0)', 4)} AS balanced_accuracy, {r('avg(precision)', 4)} AS macro_precision, {r('avg(recall)', 4)} AS macro_recall, {r('avg(f1)', 4)} AS macro_f1 FROM ({_REPORT}))"),
    "a33_class_cost": _o(f"SELECT count(*) AS n, {r(f'avg({_COST})', 4)} AS cost_weighted_error FROM ({_CLASSES})"),
    "a39_field_quality": _o(f"SELECT field, count(*) AS n, {r('avg(CAST(array_to_string(p, $$ $$) = array_to_string(q, $$ $$) AS INT))', 4)} AS exact_match, {r('avg(f1)', 4)} AS token_f1, {r('avg(CASE WHEN field = $$gross_salary$$ THEN CASE WHEN abs(TRY_CAST(truth AS DOUBLE) - TRY_CAST(found AS DOUBLE)) <= 1 THEN 1 ELSE 0 END END)', 4)} AS numeric_match FROM (SELECT *, {_F1} AS f1 FROM (SELECT *, {_W.format('truth')} AS p, {_W.format('found')} AS q FROM ({_TRUTHS}))) GROUP BY 1"),
    "a40_text_errors": oracle(f"SELECT source, count(*) AS n, {r('avg(cer)', 4)} AS cer, {r('avg(wer)', 4)} AS wer FROM (SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, CASE WHEN a = '' THEN CASE WHEN b = '' THEN 0 ELSE 1 END ELSE {r('least(1, ' + edits('ca', 'cb') + ' / length(a)::DOUBLE)', 4)} END AS cer, CASE WHEN len(p) = 0 THEN CASE WHEN len(q) = 0 THEN 0 ELSE 1 END ELSE {r('least(1, ' + edits('p', 'q') + ' / len(p)::DOUBLE)', 4)} END AS wer FROM (SELECT *, {_SPLIT.format('a')} AS p, {_SPLIT.format('b')} AS q, string_split(a, '') AS ca, string_split(b, '') AS cb FROM ({_TURNS}))) GROUP BY 1", conversations_of="SELECT * FROM conversations"),
}
