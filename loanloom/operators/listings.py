"""Property listings: cleaning, quality, duplicates, comparables and valuation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.config import AGE, BATHROOMS, COMPLETENESS_WEIGHTS, FURNISHING, PARKING, PINCODES, TOTAL_FLOORS
from loanloom.functions.columns import clamp, lookup, present, rounded
from loanloom.operators import texts


def price(text: Column) -> Column:
    """Rupees of a price text; crore, lakh and million are units."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(text)), "₹|rs\\.|rs|,", ""))
    pattern = r"([0-9.]+)\s*(crore|cr|lakh|lakhs|lac|l|million)?"
    number = F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(low, pattern, 2)
    return number * F.when(unit.isin("crore", "cr"), 1e7).when(unit.isin("lakh", "lakhs", "lac", "l"), 1e5).when(unit == "million", 1e6).otherwise(1.0)


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"([0-9]+(\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def property_type(text: Column) -> Column:
    low = F.lower(text)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(has("flat") | has("apartment"), "Apartment").when(has("villa"), "Villa").when(has("house"), "Independent House").when(has("plot") | has("land"), "Plot").otherwise(F.initcap(F.trim(text)))


def transaction(text: Column) -> Column:
    low = F.lower(text)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(has("rent") | has("lease"), "Rent").when(has("sale") | has("sell"), "Sale").otherwise(F.initcap(F.trim(text)))


def cleaned(raw: DataFrame) -> DataFrame:
    c = F.col
    df = raw.select("listing_id", "source", "source_url", "city", "locality", "bathrooms", "total_floors", "furnishing", "floor", "property_age", "parking", "pincode", "listing_age_days", first_number(c("bedrooms_text")).cast("int").alias("bedrooms"), first_number(c("area_text")).alias("area_sqft"), price(c("price_text")).alias("price_inr"), property_type(c("property_type_text")).alias("property_type"), transaction(c("transaction_text")).alias("transaction_type"))
    return df.withColumn("price_per_sqft", F.when((c("area_sqft") > 0) & (c("price_inr") > 0), rounded(c("price_inr") / c("area_sqft"), 2)))


def empty(x: Column) -> Column:
    """Null, blank or zero."""
    text = F.trim(x.cast("string"))
    return x.isNull() | (text == "") | F.coalesce(x.try_cast("double") == 0, F.lit(False))


def _lacks(x: Column) -> Column:
    """Null, the empty text or zero: what completeness doesn't count. White space counts as filled."""
    return x.isNull() | (x.cast("string") == "") | F.coalesce(x.try_cast("double") == 0, F.lit(False))


def completeness(c) -> Column:
    """0 to 100: the weights of the filled fields, of all eleven."""
    total = sum(COMPLETENESS_WEIGHTS.values())
    return rounded(sum((F.when(_lacks(c(n)), 0.0).otherwise(float(w)) for n, w in COMPLETENESS_WEIGHTS.items()), F.lit(0.0)) * 100.0 / total, 1)


def scored(clean: DataFrame, sources: Column | None = None, imputed: Column | None = None) -> DataFrame:
    """Completeness, freshness, quality and its label. sources: how many sources a listing has (1), worth 10
    points each up to 30; imputed: how many of its fields were imputed (0), 2 points less each."""
    c = F.col
    sources, imputed = F.lit(1) if sources is None else sources, F.lit(0) if imputed is None else imputed
    age = c("listing_age_days")
    freshness = F.when(age.isNull(), 50).when(age <= 7, 100).when(age <= 30, 90).when(age <= 60, 70).when(age <= 90, 50).when(age <= 180, 30).otherwise(10)
    df = clean.withColumns({"completeness": completeness(c), "freshness": freshness})
    raw = 0.7 * c("completeness") + 0.1 * c("freshness") + F.least(10.0 * sources, F.lit(30.0)) - 2.0 * imputed
    df = df.withColumn("quality", clamp(rounded(raw, 1), 0.0, 100.0))
    return df.withColumn("quality_label", F.when(c("quality") >= 80, "Excellent").when(c("quality") >= 60, "Good").when(c("quality") >= 40, "Fair").when(c("quality") >= 20, "Poor").otherwise("Very Poor"))


def imputed(clean: DataFrame) -> DataFrame:
    """clean with empty fields filled from the listing's kind, in order, imputed_fields (their names) and the
    quality of the result; imputed fields cost it nothing here."""
    c = F.col
    floors = F.when(empty(c("total_floors")), F.coalesce(lookup(c("property_type"), TOTAL_FLOORS), c("total_floors"))).otherwise(c("total_floors"))
    filled = {
        "bathrooms": F.when(empty(c("bathrooms")), F.coalesce(lookup(c("bedrooms"), BATHROOMS), c("bathrooms"))).otherwise(c("bathrooms")),
        "furnishing": F.when(empty(c("furnishing")), F.coalesce(lookup(c("property_type"), FURNISHING), c("furnishing"))).otherwise(c("furnishing")),
        "parking": F.when(empty(c("parking")), F.coalesce(lookup(c("property_type"), PARKING), c("parking"))).otherwise(c("parking")),
        "total_floors": floors,
        "floor": F.when(empty(c("floor")) & (floors > 0), F.floor(floors / 2).cast("int")).otherwise(c("floor")),
        "property_age": F.when(empty(c("property_age")), AGE).otherwise(c("property_age")),
        "pincode": F.when(empty(c("pincode")), F.coalesce(lookup(F.lower(F.trim("locality")), PINCODES), c("pincode"))).otherwise(c("pincode")),
    }
    known = {
        "bathrooms": lookup(c("bedrooms"), BATHROOMS).isNotNull(), "furnishing": lookup(c("property_type"), FURNISHING).isNotNull(), "parking": lookup(c("property_type"), PARKING).isNotNull(),
        "total_floors": lookup(c("property_type"), TOTAL_FLOORS).isNotNull(), "floor": F.coalesce(floors > 0, F.lit(False)), "property_age": F.lit(True), "pincode": lookup(F.lower(F.trim("locality")), PINCODES).isNotNull(),
    }
    names = present(*[(empty(c(n)) & known[n], n) for n in filled])
    return scored(clean.withColumns(filled | {"imputed_fields": names}))


def first_of_url(clean: DataFrame) -> DataFrame:
    """One listing of each url, bedrooms, area and price; a null url is never a duplicate."""
    w = W.partitionBy("source_url", "bedrooms", "area_sqft", "price_inr").orderBy("listing_id")
    with_url = clean.where("source_url is not null").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return with_url.unionByName(clean.where("source_url is null"))


def kind(text: Column) -> Column:
    """A property type as comparables are matched by it."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("apartment") | has("flat"), "apartment").when(has("independent house") | has("independent floor"), "independent house").when(has("villa"), "villa").when(has("plot") | has("land"), "plot").otherwise(low)


#: Areas within 20 % of each other are in the same or a neighbouring bucket of this width.
_BUCKET = math.log(1.25)


def comparables(subjects: DataFrame, listings: DataFrame, k: int = 20) -> DataFrame:
    """The k best sale listings of each subject's city, locality and kind, with its bedrooms and within 20 % of
    its area where both say. Subjects that ask the same are one question; area is part of the join key (a
    listing meets subjects of three neighbouring buckets alone), and ranks use a limit before the shuffle."""
    c = F.col
    place = lambda city, locality: (F.lower(texts.city(c(city))), F.lower(F.trim(locality)))
    s_city, s_locality = place("city", "locality")
    s = subjects.select("application_id", s_city.alias("city"), s_locality.alias("locality"), kind(c("property_type")).alias("kind"), "bhk", c("area_sqft").alias("s_area"))
    asked = ["city", "locality", "kind", "bhk", "s_area"]
    questions = s.select(*asked).distinct()
    l_city, l_locality = place("city", "locality")
    bucket = lambda x: F.coalesce(F.when(x > 0, F.floor(F.ln(x) / _BUCKET)), F.lit(-1))
    x = listings.where("transaction_type = 'Sale' and price_inr > 0 and price_per_sqft is not null and quality >= 40").select("listing_id", l_city.alias("city"), l_locality.alias("locality"), kind(c("property_type")).alias("kind"), "bedrooms", c("area_sqft").alias("l_area"), "price_per_sqft", "quality")
    fits = (c("bhk").isNull() | c("bedrooms").isNull() | (c("bhk") == c("bedrooms"))) & (c("s_area").isNull() | c("l_area").isNull() | c("l_area").between(0.8 * c("s_area"), 1.2 * c("s_area")))
    narrow = questions.where("s_area is not null").withColumn("bucket", F.explode(F.array(*[bucket(c("s_area")) + d for d in (-1, 0, 1)], F.lit(-1))))
    keys = ["city", "locality", "kind"]
    pairs = narrow.join(x.withColumn("bucket", bucket(c("l_area"))), [*keys, "bucket"]).drop("bucket").unionByName(questions.where("s_area is null").join(x, keys)).where(fits)
    w = W.partitionBy(*asked).orderBy(F.desc("quality"), F.abs(F.coalesce(c("l_area"), c("s_area")) - c("s_area")), "listing_id")
    best = pairs.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k).select(*[c(n).alias(f"q_{n}") for n in asked], "rank", "listing_id", "l_area", "price_per_sqft", "quality")
    on = F.lit(True)
    for n in asked:
        on = on & c(n).eqNullSafe(c(f"q_{n}"))
    return s.join(best, on).select("application_id", "rank", "listing_id", "s_area", "l_area", "price_per_sqft", "quality")


def mean_value(found: DataFrame) -> DataFrame:
    """Mean price per square foot of the comparables times the area; null without an area."""
    return found.groupBy("application_id").agg(F.count("*").alias("n"), rounded(F.avg("price_per_sqft") * F.first("s_area"), 2).alias("estimated_value"))


def _medians(prices: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Count and median of price_per_sqft: equal prices are counted before they meet."""
    counts = prices.groupBy(*keys, "price_per_sqft").agg(F.count("*").alias("k"))
    return counts.groupBy(*keys).agg(F.sum("k").alias(f"n_{name}"), F.percentile("price_per_sqft", F.lit(0.5), F.col("k")).alias(name))


def median_value(subjects: DataFrame, listings: DataFrame, least: int = 3) -> DataFrame:
    """Median price per square foot of the locality, or of the city where the locality has fewer than
    least listings. Both scopes are aggregated once; no listing meets a subject."""
    use = listings.where("transaction_type = 'Sale' and price_per_sqft > 0").select(F.lower("city").alias("city"), F.lower("locality").alias("locality"), F.col("bedrooms").alias("bhk"), "price_per_sqft")
    near, wide = _medians(use, ["city", "locality", "bhk"], "near"), _medians(use, ["city", "bhk"], "wide")
    s = subjects.select("application_id", F.lower("city").alias("city"), F.lower("locality").alias("locality"), "bhk", "area_sqft")
    df = s.join(near, ["city", "locality", "bhk"], "left").join(wide, ["city", "bhk"], "left")
    local = F.coalesce(F.col("n_near") >= least, F.lit(False))
    df = df.withColumns({"scope": F.when(local, "locality").when(F.col("n_wide") > 0, "city"), "n": F.when(local, F.col("n_near")).otherwise(F.coalesce("n_wide", F.lit(0))), "ppsf": F.when(local, F.col("near")).otherwise(F.col("wide"))})
    value = rounded(F.col("ppsf") * F.col("area_sqft"), 2)
    confidence = F.when(F.col("scope").isNotNull(), F.least(F.lit(0.9), 0.5 + 0.1 * F.col("n")) - F.when(F.col("scope") == "city", 0.1).otherwise(0.0))
    return df.select("application_id", "scope", "n", value.alias("estimated_value"), rounded(value * 0.9, 2).alias("low"), rounded(value * 1.1, 2).alias("high"), rounded(confidence, 2).alias("confidence"))


def chosen_value(subjects: DataFrame, live: DataFrame, listings: DataFrame) -> DataFrame:
    """The valuation of each subject from three sources: the median of live listings, else the mean of its
    comparables (confidence 0.70), else the median of all listings (0.65 of a locality, 0.55 of a city), else 0.
    Where the first two differ by more than a quarter, the confidence is 0.15 less. flags say why."""
    c = F.col
    first = median_value(subjects, live).select("application_id", *[c(x).alias(f"a_{x}") for x in ("scope", "n", "estimated_value", "low", "high", "confidence")])
    second = mean_value(comparables(subjects, listings)).select("application_id", c("n").alias("b_n"), c("estimated_value").alias("b_value"))
    third = median_value(subjects, listings).select("application_id", *[c(x).alias(f"c_{x}") for x in ("scope", "n", "estimated_value", "low", "high")])
    df = first.join(second, "application_id", "left").join(third, "application_id")
    is_a, is_b, is_c = (F.coalesce(c(x) > 0, F.lit(False)) for x in ("a_estimated_value", "b_value", "c_estimated_value"))
    pick = lambda a, b, d, none: F.when(is_a, a).when(is_b, b).when(is_c, d).otherwise(none)
    difference = F.when(is_a & is_b, F.abs(c("b_value") - c("a_estimated_value")) / c("a_estimated_value")).otherwise(0.0)
    far = difference > 0.25
    confidence = pick(F.greatest(F.lit(0.0), c("a_confidence") - F.when(far, 0.15).otherwise(0.0)), F.lit(0.70), F.when(c("c_scope") == "locality", 0.65).otherwise(0.55), F.lit(0.0))
    flags = present((is_a & (c("a_scope") == "city"), "city_wide_listings"), (is_a & (c("a_n") < 2), "few_comparables"), (far, "sources_disagree"), (~is_a & is_b, "database_comparables"), (~is_a & ~is_b & is_c, "local_median"), (~is_a & ~is_b & ~is_c, "no_listings"))
    return df.select("application_id", pick(F.lit("live"), F.lit("database"), F.lit("local"), F.lit("none")).alias("source"), pick(c("a_estimated_value"), c("b_value"), c("c_estimated_value"), F.lit(0.0)).alias("estimated_value"),
        pick(c("a_low"), rounded(c("b_value") * 0.9, 2), c("c_low"), F.lit(0.0)).alias("low"), pick(c("a_high"), rounded(c("b_value") * 1.1, 2), c("c_high"), F.lit(0.0)).alias("high"),
        rounded(confidence, 2).alias("confidence"), rounded(difference * 100, 2).alias("variance_pct"), flags.alias("flags"), F.coalesce("b_n", F.lit(0)).alias("n_comparables"))


def reviewed_value(chosen: DataFrame) -> DataFrame:
    """The stand-alone variant: confidence 0.90 less 1.5 times the difference of the sources, its label, and
    whether people have to look (below 0.60 or fewer than two comparables)."""
    confidence = F.when(F.col("estimated_value") > 0, clamp(0.90 - 1.5 * F.col("variance_pct") / 100, 0.0, 1.0)).otherwise(0.0)
    df = chosen.select("application_id", "source", "estimated_value", rounded(confidence, 2).alias("confidence"), "n_comparables")
    label = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return df.withColumns({"label": label, "needs_review": (F.col("confidence") < 0.60) | (F.col("n_comparables") < 2)})


def by_quality(listings: DataFrame, most: int = 100) -> DataFrame:
    """The best listings by quality, then id: a top-k report."""
    return listings.orderBy(F.desc("quality"), "listing_id").limit(most)


def summary(listings: DataFrame) -> DataFrame:
    return listings.groupBy("city").agg(F.count("*").alias("n"), F.count_distinct("locality").alias("localities"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"), rounded(F.avg("quality"), 4).alias("avg_quality"))


def nearest_credit(slips: DataFrame, credits: DataFrame) -> DataFrame:
    """The salary credit nearest to each application's net pay, 0 where its statement has none: one aggregation, no window. The variance is rounded before it is judged."""
    c = F.col
    salary = c("narration").like("%SALARY%")
    pay = slips.join(credits, "application_id")
    difference = F.when(salary, F.struct(F.abs(c("amount") - c("net_pay")).alias("d"), "line_no", "tx_ts", "l_partkey", "l_suppkey", "amount"))
    best = pay.groupBy("application_id").agg(F.min_by("amount", difference).alias("nearest"), F.first("net_pay").alias("net_pay"), F.count_if(salary).alias("n_credits"))
    amount = F.when(c("n_credits") > 0, c("nearest")).otherwise(0.0)
    variance = rounded(rounded(F.abs(c("net_pay") - amount), 2) / F.greatest(c("net_pay"), F.lit(1.0)) * 100.0, 2)
    return best.select("application_id", "n_credits", amount.alias("amount"), variance.alias("variance_pct"), F.when(variance <= 5, "MATCH").when(variance <= 15, "WITHIN_TOLERANCE").otherwise("DISCREPANCY").alias("status"))
