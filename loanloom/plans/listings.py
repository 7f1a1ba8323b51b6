"""Listing and valuation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import config
from loanloom.fixtures import once, oracle, view
from loanloom.operators import listings as x
from loanloom.plans.sql import r

_LOW = "trim(regexp_replace(lower(trim(price_text)), '₹|rs\\.|rs|,', '', 'g'))"
_P = "'([0-9.]+)\\s*(crore|cr|lakh|lakhs|lac|l|million)?'"
CLEAN_SQL = f"""SELECT *, CASE WHEN area_sqft > 0 AND price_inr > 0 THEN {r("price_inr / area_sqft", 2)} END AS price_per_sqft FROM (SELECT listing_id, source, source_url, city, locality, bathrooms, total_floors, furnishing, floor, property_age, parking, pincode, listing_age_days, TRY_CAST(regexp_extract(bedrooms_text, '[0-9]+') AS INT) AS bedrooms, TRY_CAST(regexp_extract(area_text, '[0-9]+') AS DOUBLE) AS area_sqft,
 TRY_CAST(regexp_extract({_LOW}, {_P}, 1) AS DOUBLE) * CASE WHEN regexp_extract({_LOW}, {_P}, 2) IN ('crore', 'cr') THEN 10000000 WHEN regexp_extract({_LOW}, {_P}, 2) IN ('lakh', 'lakhs', 'lac', 'l') THEN 100000 WHEN regexp_extract({_LOW}, {_P}, 2) = 'million' THEN 1000000 ELSE 1 END AS price_inr,
 CASE WHEN contains(lower(property_type_text), 'flat') OR contains(lower(property_type_text), 'apartment') THEN 'Apartment' WHEN contains(lower(property_type_text), 'villa') THEN 'Villa' WHEN contains(lower(property_type_text), 'house') THEN 'Independent House' ELSE 'Plot' END AS property_type,
 CASE WHEN contains(lower(transaction_text), 'rent') THEN 'Rent' ELSE 'Sale' END AS transaction_type FROM raw_listings)"""
_WEIGHTS = {"locality": 20, "price_inr": 20, "area_sqft": 15, "bedrooms": 10, "bathrooms": 5, "furnishing": 5, "floor": 5, "total_floors": 5, "property_age": 5, "parking": 5, "pincode": 5}
_FILLED = " + ".join(f"CASE WHEN coalesce(CAST({n} AS VARCHAR), '') NOT IN ('', '0', '0.0') THEN {w} ELSE 0 END" for n, w in _WEIGHTS.items())


def _scored(source):
    return f"""SELECT *, CASE WHEN quality >= 80 THEN 'Excellent' WHEN quality >= 60 THEN 'Good' WHEN quality >= 40 THEN 'Fair' WHEN quality >= 20 THEN 'Poor' ELSE 'Very Poor' END AS quality_label FROM (SELECT *, {r("least(100, 0.7::DOUBLE * completeness + 0.1::DOUBLE * freshness + 10)", 1)} AS quality FROM (SELECT *,
 ({_FILLED})::DOUBLE AS completeness, CASE WHEN listing_age_days IS NULL THEN 50 WHEN listing_age_days <= 7 THEN 100 WHEN listing_age_days <= 30 THEN 90 WHEN listing_age_days <= 60 THEN 70 WHEN listing_age_days <= 90 THEN 50 WHEN listing_age_days <= 180 THEN 30 ELSE 10 END AS freshness FROM {source}))"""


SCORED_SQL = _scored("clean")


def _case(column, table, quote=True):
    return f"CASE {column} " + " ".join(f"WHEN {repr(k)} THEN {repr(v)}" for k, v in table.items()) + " END"


def _none(column):
    return f"(coalesce(trim(CAST({column} AS VARCHAR)), '') IN ('', '0', '0.0'))"


_GUESS = {"bathrooms": _case("bedrooms", config.BATHROOMS), "furnishing": _case("property_type", config.FURNISHING), "parking": _case("property_type", config.PARKING), "total_floors": _case("property_type", config.TOTAL_FLOORS), "property_age": "5", "pincode": _case("lower(trim(locality))", config.PINCODES)}
_FILL = {n: f"CASE WHEN {_none(n)} THEN coalesce({g}, {n}) ELSE {n} END" for n, g in _GUESS.items()}
_FLOORS = f"({_FILL['total_floors']})"
_NAMED = ", ".join(f"CASE WHEN {_none(n)} AND ({x}) THEN '{n}' END" for n, x in (("bathrooms", _GUESS["bathrooms"] + " IS NOT NULL"), ("furnishing", _GUESS["furnishing"] + " IS NOT NULL"), ("parking", _GUESS["parking"] + " IS NOT NULL"), ("total_floors", _GUESS["total_floors"] + " IS NOT NULL"), ("floor", f"{_FLOORS} > 0"), ("property_age", "true"), ("pincode", _GUESS["pincode"] + " IS NOT NULL")))
IMPUTED_SQL = f"SELECT * REPLACE ({', '.join(f'{x} AS {n}' for n, x in _FILL.items())}, CASE WHEN {_none('floor')} AND {_FLOORS} > 0 THEN CAST(floor({_FLOORS} / 2) AS INT) ELSE floor END AS floor), concat_ws(',', {_NAMED}) AS imputed_fields FROM clean"
ENRICHED_SQL = _scored("filled")


def _kind(x):
    low = f"trim(lower(coalesce({x}, '')))"
    return f"CASE WHEN contains({low}, 'apartment') OR contains({low}, 'flat') THEN 'apartment' WHEN contains({low}, 'independent house') OR contains({low}, 'independent floor') THEN 'independent house' WHEN contains({low}, 'villa') THEN 'villa' WHEN contains({low}, 'plot') OR contains({low}, 'land') THEN 'plot' ELSE {low} END"


_COMP = f"SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY quality DESC, abs(coalesce(l_area, s_area) - s_area), listing_id) AS k FROM (SELECT s.application_id, l.listing_id, s.area_sqft AS s_area, l.area_sqft AS l_area, price_per_sqft, quality FROM subjects s JOIN scored l ON lower(s.city) = lower(l.city) AND lower(trim(s.locality)) = lower(trim(l.locality)) AND {_kind('s.property_type')} = {_kind('l.property_type')} AND (s.bhk IS NULL OR l.bedrooms IS NULL OR s.bhk = l.bedrooms) AND (s.area_sqft IS NULL OR l.area_sqft IS NULL OR l.area_sqft BETWEEN 0.8::DOUBLE * s.area_sqft AND 1.2::DOUBLE * s.area_sqft) WHERE transaction_type = 'Sale' AND price_inr > 0 AND price_per_sqft IS NOT NULL AND quality >= 40)"


@once
def clean(s, d):
    return x.cleaned(view(s, d, "raw_listings"))


@once
def scored(s, d):
    return x.scored(clean(s, d))


@once
def chosen(s, d):
    """The listings of one source stand for a live feed."""
    live = F.col("source") == "square_yards"
    return x.chosen_value(view(s, d, "subjects"), clean(s, d).where(live), scored(s, d))


def slips(s, d):
    return view(s, d, "applications").select("application_id", (F.col("monthly_income") - F.floor(F.col("monthly_income") / 10)).alias("net_pay"))


def _o(sql, *more):
    return oracle(sql, "raw_listings", "subjects", *more, clean=CLEAN_SQL, scored=SCORED_SQL, filled=IMPUTED_SQL, enriched=ENRICHED_SQL, comp=_COMP, live="SELECT * FROM clean WHERE source = 'square_yards'", a=_median("live"), c=_MEDIAN, b=_MEAN)


QUERIES = {
    "l01_price": lambda s, d: clean(s, d).select("listing_id", "price_inr"),
    "l04_property_type": lambda s, d: clean(s, d).select("listing_id", "property_type", "transaction_type"),
    "l07_clean_listing": lambda s, d: clean(s, d).select("listing_id", "bedrooms", "area_sqft", "price_inr", "price_per_sqft", "property_type", "transaction_type"),
    "l22_quality": lambda s, d: scored(s, d).select("listing_id", "completeness", "freshness", "quality", "quality_label"),
    "l24_imputed": lambda s, d: x.imputed(clean(s, d)).select("listing_id", "bathrooms", "furnishing", "parking", "total_floors", "floor", "property_age", "pincode", F.array_join("imputed_fields", ",").alias("imputed_fields"), "quality"),
    "l25_enriched_by_city": lambda s, d: x.summary(x.imputed(clean(s, d))),
    "f11_empty": lambda s, d: clean(s, d).select("listing_id", *[x.empty(F.col(n)).alias(n) for n in ("locality", "furnishing", "total_floors", "property_age")]),
    "t02_by_quality": lambda s, d: x.by_quality(scored(s, d)).select("listing_id", "quality"),
    "a52_chosen_value": lambda s, d: chosen(s, d).select("application_id", "source", "estimated_value", "low", "high", "confidence", "variance_pct", F.array_join("flags", ",").alias("flags"), "n_comparables"),
    "a53_reviewed_value": lambda s, d: x.reviewed_value(chosen(s, d)),
    "w04_first_of_url": lambda s, d: x.first_of_url(clean(s, d)).select("listing_id", "source_url"),
    "a13_listing_summary": lambda s, d: x.summary(scored(s, d)),
    "t01_top_comparables": lambda s, d: x.comparables(view(s, d, "subjects"), scored(s, d)).select("application_id", "rank", "listing_id", "price_per_sqft"),
    "a51_mean_valuation": lambda s, d: x.mean_value(x.comparables(view(s, d, "subjects"), scored(s, d))),
    "a50_median_valuation": lambda s, d: x.median_value(view(s, d, "subjects"), clean(s, d)),
    "j04_nearest_credit": lambda s, d: x.nearest_credit(slips(s, d), view(s, d, "bank_credits")),
}


def _median(source):
    return f"""SELECT application_id, scope, n, {r("v", 2)} AS estimated_value, {r(r("v", 2) + " * 0.9::DOUBLE", 2)} AS low, {r(r("v", 2) + " * 1.1::DOUBLE", 2)} AS high, {r("CASE WHEN scope IS NOT NULL THEN least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * n) - CASE scope WHEN 'city' THEN 0.1::DOUBLE ELSE 0 END END", 2)} AS confidence FROM (
 SELECT s.application_id, CASE WHEN nn >= 3 THEN 'locality' WHEN nw > 0 THEN 'city' END AS scope, CASE WHEN nn >= 3 THEN nn ELSE coalesce(nw, 0) END AS n, CASE WHEN nn >= 3 THEN mn ELSE mw END * area_sqft AS v FROM subjects s
 LEFT JOIN (SELECT lower(city) AS c, lower(locality) AS l, bedrooms AS b, count(*) AS nn, median(price_per_sqft) AS mn FROM {source} WHERE transaction_type = 'Sale' AND price_per_sqft > 0 GROUP BY 1, 2, 3) a ON a.c = lower(s.city) AND a.l = lower(s.locality) AND a.b = s.bhk
 LEFT JOIN (SELECT lower(city) AS c, bedrooms AS b, count(*) AS nw, median(price_per_sqft) AS mw FROM {source} WHERE transaction_type = 'Sale' AND price_per_sqft > 0 GROUP BY 1, 2) w ON w.c = lower(s.city) AND w.b = s.bhk)"""


_MEDIAN = _median("clean")
_MEAN = f"SELECT application_id, count(*) AS n, {r('avg(price_per_sqft) * max(s_area)', 2)} AS estimated_value FROM comp WHERE k <= 20 GROUP BY 1"
_VAR = r(r("abs(net_pay - amount)", 2) + " / greatest(net_pay, 1) * 100.0::DOUBLE", 2)
_DIFFERENCE = "CASE WHEN a.estimated_value > 0 AND b.estimated_value > 0 THEN abs(b.estimated_value - a.estimated_value) / a.estimated_value ELSE 0 END"


def _pick(a, b, c, none):
    return f"CASE WHEN a.estimated_value > 0 THEN {a} WHEN b.estimated_value > 0 THEN {b} WHEN c.estimated_value > 0 THEN {c} ELSE {none} END"


_CHOSEN = f"""SELECT a.application_id, {_pick("'live'", "'database'", "'local'", "'none'")} AS source, {_pick("a.estimated_value", "b.estimated_value", "c.estimated_value", "0")} AS estimated_value, {_pick("a.low", r("b.estimated_value * 0.9::DOUBLE", 2), "c.low", "0")} AS low, {_pick("a.high", r("b.estimated_value * 1.1::DOUBLE", 2), "c.high", "0")} AS high,
 {r(_pick(f"greatest(0, a.confidence - CASE WHEN {_DIFFERENCE} > 0.25::DOUBLE THEN 0.15::DOUBLE ELSE 0 END)", "0.7::DOUBLE", "CASE c.scope WHEN 'locality' THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END", "0"), 2)} AS confidence, {r(f"({_DIFFERENCE}) * 100", 2)} AS variance_pct,
 concat_ws(',', CASE WHEN a.estimated_value > 0 AND a.scope = 'city' THEN 'city_wide_listings' END, CASE WHEN a.estimated_value > 0 AND a.n < 2 THEN 'few_comparables' END, CASE WHEN {_DIFFERENCE} > 0.25::DOUBLE THEN 'sources_disagree' END, {_pick("NULL", "'database_comparables'", "'local_median'", "'no_listings'")}) AS flags, coalesce(b.n, 0) AS n_comparables
FROM a LEFT JOIN b ON b.application_id = a.application_id JOIN c ON c.application_id = a.application_id"""
ORACLE = {
    "l01_price": _o("SELECT listing_id, price_inr FROM clean"),
    "l04_property_type": _o("SELECT listing_id, property_type, transaction_type FROM clean"),
    "l07_clean_listing": _o("SELECT listing_id, bedrooms, area_sqft, price_inr, price_per_sqft, property_type, transaction_type FROM clean"),
    "l22_quality": _o("SELECT listing_id, completeness, freshness, quality, quality_label FROM scored"),
    "w04_first_of_url": _o("SELECT listing_id, source_url FROM clean WHERE source_url IS NULL UNION ALL SELECT min(listing_id), source_url FROM clean WHERE source_url IS NOT NULL GROUP BY source_url, bedrooms, area_sqft, price_inr"),
    "a13_listing_summary": _o(f"SELECT city, count(*) AS n, count(DISTINCT locality) AS localities, min(quality) AS min_quality, max(quality) AS max_quality, {r('avg(quality)', 4)} AS avg_quality FROM scored GROUP BY 1"),
    "t01_top_comparables": _o("SELECT application_id, CAST(k AS INT) AS rank, listing_id, price_per_sqft FROM comp WHERE k <= 20"),
    "a51_mean_valuation": _o(f"SELECT application_id, count(*) AS n, {r('avg(price_per_sqft) * max(s_area)', 2)} AS estimated_value FROM comp WHERE k <= 20 GROUP BY 1"),
    "a50_median_valuation": _o(_MEDIAN),
    "l24_imputed": _o("SELECT listing_id, bathrooms, furnishing, parking, total_floors, floor, property_age, pincode, imputed_fields, quality FROM enriched"),
    "l25_enriched_by_city": _o(f"SELECT city, count(*) AS n, count(DISTINCT locality) AS localities, min(quality) AS min_quality, max(quality) AS max_quality, {r('avg(quality)', 4)} AS avg_quality FROM enriched GROUP BY 1"),
    "f11_empty": _o("SELECT listing_id, " + ", ".join(f"{_none(n)} AS {n}" for n in ("locality", "furnishing", "total_floors", "property_age")) + " FROM clean"),
    "t02_by_quality": _o("SELECT listing_id, quality FROM scored ORDER BY quality DESC, listing_id LIMIT 100"),
    "a52_chosen_value": _o(_CHOSEN),
    "a53_reviewed_value": _o(f"SELECT *, CASE WHEN confidence >= 0.8::DOUBLE THEN 'high' WHEN confidence >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS label, confidence < 0.6::DOUBLE OR n_comparables < 2 AS needs_review FROM (SELECT application_id, source, estimated_value, n_comparables, {r('CASE WHEN estimated_value > 0 THEN greatest(0, least(1, 0.9::DOUBLE - 1.5::DOUBLE * variance_pct / 100)) ELSE 0 END', 2)} AS confidence FROM ({_CHOSEN}))"),
    "j04_nearest_credit": oracle(f"SELECT *, CASE WHEN variance_pct <= 5 THEN 'MATCH' WHEN variance_pct <= 15 THEN 'WITHIN_TOLERANCE' ELSE 'DISCREPANCY' END AS status FROM (SELECT application_id, n_credits, amount, {_VAR} AS variance_pct FROM (SELECT application_id, max(net_pay) AS net_pay, count(*) FILTER (WHERE narration LIKE '%SALARY%') AS n_credits, coalesce(arg_min(amount, (abs(amount - net_pay), line_no, tx_ts, l_partkey, l_suppkey, amount)) FILTER (WHERE narration LIKE '%SALARY%'), 0) AS amount FROM bank_credits JOIN (SELECT application_id, monthly_income - floor(monthly_income / 10) AS net_pay FROM applications) USING (application_id) GROUP BY 1))", "applications", "bank_credits"),
}
