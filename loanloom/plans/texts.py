"""Queries of names, fields, pages, comparisons and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import oracle, query, view
from loanloom.functions.columns import joined
from loanloom.operators import listings, reports, texts
from loanloom.plans.credit import CREDIT_SQL, assessed
from loanloom.plans.sql import r
from loanloom.plans.listings import _MEDIAN, CLEAN_SQL, clean
from loanloom.plans.monitoring import _BAND, EDGES
from loanloom.sources import listing_table

#: Numbers and city texts in several states of repair, made from each application's key.
NUMBERS = """SELECT application_id,
 CASE WHEN application_id % 11 = 0 THEN concat('XXXX-XXXX-', CAST(1000 + application_id % 9000 AS STRING)) WHEN application_id % 17 = 0 THEN NULL
  ELSE concat(CAST(application_id % 10 AS STRING), '234 5678 ', CAST(1000 + application_id % 9000 AS STRING)) END AS national_number,
 CASE WHEN application_id % 5 = 0 THEN 'abcd1000123' WHEN application_id % 19 = 0 THEN NULL ELSE concat(' abcd0', lpad(CAST(application_id % 1000000 AS STRING), 6, '0')) END AS branch_code,
 CASE WHEN application_id % 3 = 0 THEN ' bangalore ' WHEN application_id % 3 = 1 THEN concat(' ', upper(split_part('{cities}', ',', CAST(1 + application_id % {n} AS INT)))) ELSE city END AS city_text
FROM case_inputs""".replace("{cities}", ",".join(texts.CITY)).replace("{n}", str(len(texts.CITY)))


def numbers(spark, sf_dir):
    return query(spark, sf_dir, NUMBERS, "case_inputs")


def f01_name_similarity(spark, sf_dir):
    return view(spark, sf_dir, "case_inputs").select("application_id", texts.name_similarity(F.col("name"), F.col("aadhaar_name")).alias("similarity"))


def f06_word_f1(spark, sf_dir):
    a, b = F.col("name"), F.col("pan_card_name")
    return view(spark, sf_dir, "case_inputs").select("application_id", texts.same_field(a, b).alias("same"), texts.word_f1(a, b).alias("f1"))


def v02_national_number(spark, sf_dir):
    return numbers(spark, sf_dir).select("application_id", texts.national_number_valid(F.col("national_number")).alias("valid"))


def v03_branch_code(spark, sf_dir):
    return numbers(spark, sf_dir).select("application_id", texts.branch_code_valid(F.col("branch_code")).alias("valid"))


def v04_salary_arithmetic(spark, sf_dir):
    slips = view(spark, sf_dir, "doc_texts").where("true_type = 'SALARY_SLIP'")
    gross, less, net = (texts.amount_after(F.col("text"), x) for x in ("Gross Salary", "Total Deductions", "Net Pay"))
    return slips.select("application_id", gross.alias("gross"), less.alias("deductions"), net.alias("net"), (F.abs(gross - less - net) <= 2).alias("adds_up"))


def l08_city(spark, sf_dir):
    return numbers(spark, sf_dir).select("application_id", texts.city(F.col("city_text")).alias("city"))


def d18_property_pages(spark, sf_dir):
    return view(spark, sf_dir, "listing_pages").select("page_id", texts.is_property_page(F.col("url")).alias("property_page"))


def l27_refused_pages(spark, sf_dir):
    return view(spark, sf_dir, "listing_pages").select("page_id", texts.is_refused_page(F.col("html")).alias("refused"))


def j12_compared(spark, sf_dir):
    found = reports.compared(assessed(spark, sf_dir), view(spark, sf_dir, "case_inputs"))
    return found.select("application_id", joined(F.col("agreement")).alias("agreement"), joined(F.col("disagreement")).alias("disagreement"), "material")


def a20_quantile_edges(spark, sf_dir):
    return reports.quantile_edges(assessed(spark, sf_dir), "risk_score")


def a21_band_shares(spark, sf_dir):
    return reports.band_shares(assessed(spark, sf_dir), "risk_score", EDGES)


def a44_valuation_accuracy(spark, sf_dir):
    return reports.valuation_accuracy(view(spark, sf_dir, "case_inputs"), "estimated_value", "property_value")


def a11_valuation_coverage(spark, sf_dir):
    return reports.valuation_coverage(listings.median_value(view(spark, sf_dir, "subjects"), clean(spark, sf_dir)))


def j16_exact_place(spark, sf_dir):
    return reports.exact_place(view(spark, sf_dir, "subjects"), clean(spark, sf_dir))


def s10_new_by_place(spark, sf_dir):
    """Listings of two sources whose place, bedrooms and area those of the third lack."""
    found = clean(spark, sf_dir)
    batch = F.col("source") != "square_yards"
    return listing_table.new_by_key(found.where(batch), found.where(~batch)).select("listing_id", "city", "locality")


QUERIES = {
    f.__name__: f
    for f in (f01_name_similarity, f06_word_f1, v02_national_number, v03_branch_code, v04_salary_arithmetic, l08_city, d18_property_pages, l27_refused_pages,
              j12_compared, a20_quantile_edges, a21_band_shares, a44_valuation_accuracy, a11_valuation_coverage, j16_exact_place, s10_new_by_place)
}


def _n(sql):
    return oracle(sql, "case_inputs", numbers=NUMBERS)


def _amount(label):
    return f"TRY_CAST(replace(regexp_extract(text, '{label}:\\s*([0-9][0-9,]*(\\.[0-9]+)?)', 1), ',', '') AS DOUBLE)"


def _has(column, parts):
    return "(" + " OR ".join(f"contains(lower({column}), '{x}')" for x in parts) + ")"


def _far(a, b):
    return f"abs({a} - {b}) / greatest({a}, 1) < 0.1::DOUBLE"


_CITIES = " ".join(f"WHEN lower(trim(city_text)) = '{a}' THEN '{b}'" for a, b in texts.CITY.items())
_PREFIX = "len([i for i in range(1, least(length(x), length(y)) + 1) if left(x, i) = left(y, i)])"
_INITIALS = "list_sum(flatten([[CASE WHEN (length(s) = 1 AND starts_with(t, s)) OR (length(t) = 1 AND starts_with(s, t)) THEN 1 ELSE 0 END for t in q] for s in p]))"
_NAMES = """SELECT *, list_distinct([w for w in string_split_regex(x, '\\s+') if w <> '']) AS p, list_distinct([w for w in string_split_regex(y, '\\s+') if w <> '']) AS q FROM (
 SELECT application_id, trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')) AS x, trim(regexp_replace(lower(aadhaar_name), '[^a-z0-9\\s]', '', 'g')) AS y FROM case_inputs)"""
_FIELD = "[w for w in string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+') if w <> '']"
_FIELDS = f"SELECT application_id, {_FIELD.format('name')} AS p, {_FIELD.format('pan_card_name')} AS q FROM case_inputs"
ORACLE = {
    "f01_name_similarity": oracle(f"""SELECT application_id, CASE WHEN x = y THEN 1 ELSE {r(f"least(1, 0.7::DOUBLE * (len(list_intersect(p, q)) + 0.5::DOUBLE * {_INITIALS}) / greatest(len(p), len(q)) + 0.3::DOUBLE * ({_PREFIX} + least(length(x), length(y))) / (length(x) + length(y)))", 3)} END AS similarity FROM names""", "case_inputs", names=_NAMES),
    "f06_word_f1": oracle(f"""SELECT application_id, array_to_string(p, ' ') = array_to_string(q, ' ') AS same, CASE WHEN len(p) + len(q) = 0 THEN 1 ELSE {r("2.0::DOUBLE * coalesce(list_sum([least(len([w for w in p if w = t]), len([w for w in q if w = t])) for t in list_distinct(q)]), 0) / (len(p) + len(q))", 4)} END AS f1 FROM fields""", "case_inputs", fields=_FIELDS),
    "v02_national_number": _n(f"SELECT application_id, coalesce(regexp_matches(upper(regexp_replace(national_number, '[ -]', '', 'g')), '{texts.NATIONAL}'), false) AS valid FROM numbers"),
    "v03_branch_code": _n(f"SELECT application_id, coalesce(regexp_matches(upper(trim(branch_code)), '{texts.BRANCH}'), false) AS valid FROM numbers"),
    "v04_salary_arithmetic": oracle(f"SELECT *, abs(gross - deductions - net) <= 2 AS adds_up FROM (SELECT application_id, {_amount('Gross Salary')} AS gross, {_amount('Total Deductions')} AS deductions, {_amount('Net Pay')} AS net FROM doc_texts WHERE true_type = 'SALARY_SLIP')", "doc_texts"),
    "l08_city": _n(f"SELECT application_id, CASE WHEN trim(city_text) = '' THEN NULL {_CITIES} ELSE city_text END AS city FROM numbers"),
    "d18_property_pages": oracle(f"SELECT page_id, coalesce({_has('url', texts.PROPERTY)} AND NOT {_has('url', texts.NOT_PROPERTY)}, false) AS property_page FROM listing_pages", "listing_pages"),
    "l27_refused_pages": oracle(f"SELECT page_id, coalesce({_has('html', texts.REFUSED)}, false) AS refused FROM listing_pages", "listing_pages"),
    "j12_compared": oracle(
        f"""SELECT application_id, concat_ws(',', CASE WHEN income THEN 'monthly_income' END, CASE WHEN worth THEN 'property_value' END, CASE WHEN ratio THEN 'ltv' END) AS agreement,
 concat_ws(',', CASE WHEN NOT income THEN 'monthly_income' END, CASE WHEN NOT worth THEN 'property_value' END, CASE WHEN NOT ratio THEN 'ltv' END) AS disagreement, NOT coalesce(income, true) OR NOT coalesce(worth, true) AS material
FROM (SELECT i.application_id, CASE WHEN i.doc_monthly_income <> 0 AND c.monthly_income <> 0 THEN {_far("i.doc_monthly_income", "c.monthly_income")} END AS income,
  CASE WHEN i.estimated_value <> 0 AND i.property_value <> 0 THEN {_far("i.estimated_value", "i.property_value")} END AS worth,
  CASE WHEN c.ltv <> 0 AND i.property_value <> 0 AND i.loan_amount <> 0 THEN abs(c.ltv - i.loan_amount / i.property_value) < 0.05::DOUBLE END AS ratio FROM credit c JOIN case_inputs i ON c.application_id = i.application_id)""",
        "case_inputs",
        credit=CREDIT_SQL,
    ),
    "a20_quantile_edges": oracle(f"SELECT CAST(row_number() OVER (ORDER BY edge DESC) - 1 AS INT) AS place, edge FROM (SELECT DISTINCT {r('e', 6)} AS edge FROM (SELECT unnest(quantile_cont(risk_score, [{', '.join(str(k / 10) for k in range(1, 10))}])) AS e FROM credit))", "applications", credit=CREDIT_SQL),
    "a21_band_shares": oracle(f"SELECT CAST(k AS INT) AS band, count(b) AS n, {r('count(b) / nullif(sum(count(b)) OVER (), 0)::DOUBLE', 6)} AS share FROM range({len(EDGES) + 1}) t(k) LEFT JOIN (SELECT {_BAND} AS b FROM credit WHERE risk_score IS NOT NULL) ON b = k GROUP BY k", "applications", credit=CREDIT_SQL),
    "a44_valuation_accuracy": oracle(f"SELECT count(*) AS n, {r('100.0::DOUBLE * count(*) FILTER (WHERE e <= 10) / count(*)', 2)} AS ppe10, {r('100.0::DOUBLE * count(*) FILTER (WHERE e <= 20) / count(*)', 2)} AS ppe20, {r('median(e)', 2)} AS mdape FROM (SELECT {r('abs(estimated_value - property_value) / property_value * 100.0::DOUBLE', 4)} AS e FROM case_inputs WHERE property_value > 0 AND estimated_value IS NOT NULL)", "case_inputs"),
    "a11_valuation_coverage": oracle(f"SELECT coalesce(scope, 'none') AS source, count(*) AS n, count(*) FILTER (WHERE estimated_value > 0) AS n_valued, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 4)} AS pct FROM valued GROUP BY 1", "raw_listings", "subjects", clean=CLEAN_SQL, valued=_MEDIAN),
    "j16_exact_place": oracle("SELECT s.application_id, l.listing_id FROM subjects s JOIN clean l ON s.city = l.city AND s.locality = l.locality AND s.bhk = l.bedrooms WHERE transaction_type = 'Sale'", "raw_listings", "subjects", clean=CLEAN_SQL),
    "s10_new_by_place": oracle(
        """SELECT min(listing_id) AS listing_id, city, locality FROM clean b WHERE source <> 'square_yards' AND NOT EXISTS (SELECT 1 FROM clean e WHERE e.source = 'square_yards'
 AND e.city IS NOT DISTINCT FROM b.city AND e.locality IS NOT DISTINCT FROM b.locality AND e.bedrooms IS NOT DISTINCT FROM b.bedrooms AND e.area_sqft IS NOT DISTINCT FROM b.area_sqft)
GROUP BY city, locality, bedrooms, area_sqft""",
        "raw_listings",
        clean=CLEAN_SQL,
    ),
}
