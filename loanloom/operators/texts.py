"""Names, field texts, identifiers and pages; columns only, so they stay in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom.functions.columns import lookup, rounded
from loanloom.functions.names import bound

#: Common spellings of cities and the one used.
CITY = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "mumbai": "Mumbai", "delhi": "Delhi", "new delhi": "Delhi",
    "hyderabad": "Hyderabad", "chennai": "Chennai", "pune": "Pune", "kolkata": "Kolkata", "ahmedabad": "Ahmedabad",
    "jaipur": "Jaipur", "lucknow": "Lucknow", "gurgaon": "Gurgaon", "gurugram": "Gurgaon", "noida": "Noida",
    "thane": "Thane", "navi mumbai": "Navi Mumbai", "ghaziabad": "Ghaziabad", "faridabad": "Faridabad", "greater noida": "Greater Noida",
}
#: Parts of addresses that no property page has, and parts that one has.
NOT_PROPERTY = ("/project/", "/projects/", "/property-rates", "/heatmap", "/calculator", "/guides", "/localities", "/property-search", "/residential-property", "/commercial-property")
PROPERTY = ("-npd-", "/property-card/")
#: What a page says that was refused.
REFUSED = ("access denied", "request blocked", "security alert", "captcha", "robot", "bot detected", "suspicious activity", "blocked")
#: The formats of a bank branch code and of a national number, masked or whole.
BRANCH = "^[A-Z]{4}0[A-Z0-9]{6}$"
NATIONAL = "^(X{8}[0-9]{4}|[2-9][0-9]{11})$"


def _words(clean: Column) -> Column:
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def name_similarity(a: Column, b: Column) -> Column:
    """0 to 1: shared words, initials counted half, and the common prefix, weighted 0.7 and 0.3. Names
    that are equal but for case and punctuation give 1, missing ones 0."""
    # bound: lambdas would work out the cleaned names and their words anew for each word and letter
    clean = lambda n: F.trim(F.regexp_replace(F.lower(n), r"[^a-z0-9\s]", ""))
    initial = lambda s, t: (F.length(s) == 1) & F.startswith(t, s)

    def of(n: Column) -> Column:
        x, y, p, q = n["x"], n["y"], n["p"], n["q"]
        initials = F.size(F.flatten(F.transform(p, lambda s: F.filter(q, lambda t: initial(s, t) | initial(t, s)))))
        by_words = F.try_divide(F.size(F.array_intersect(p, q)) + 0.5 * initials, F.greatest(F.size(p), F.size(q)))
        shorter, both = F.least(F.length(x), F.length(y)), F.length(x) + F.length(y)
        prefix = F.when(shorter > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.left(x, i) == F.left(y, i)))).otherwise(0)
        score = F.least(F.lit(1.0), 0.7 * by_words + 0.3 * F.try_divide(prefix + shorter, both))
        return F.when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(rounded(score, 3))

    words = lambda n: F.array_distinct(_words(n))
    differing = lambda n: bound(of, x=n["x"], y=n["y"], p=words(n["x"]), q=words(n["y"]))
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, 0.0).otherwise(bound(lambda n: F.when(n["x"] == n["y"], 1.0).otherwise(differing(n)), x=clean(a), y=clean(b)))


def field_words(x: Column) -> Column:
    """The words of a field without case and punctuation; none for null."""
    return _words(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def same_field(a: Column, b: Column) -> Column:
    return F.array_join(field_words(a), " ") == F.array_join(field_words(b), " ")


def word_f1(a: Column, b: Column) -> Column:
    """F1 of the words two short fields share, repeats counted; 1 where both are empty."""
    x, y = field_words(a), field_words(b)
    count = lambda words, t: F.size(F.filter(words, lambda w: w == t))
    shared = F.aggregate(F.array_distinct(y), F.lit(0), lambda n, t: n + F.least(count(x, t), count(y, t)))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(rounded(F.try_divide(2.0 * shared, total), 4))


def national_number_valid(x: Column) -> Column:
    return F.coalesce(F.upper(F.regexp_replace(x, "[ -]", "")).rlike(NATIONAL), F.lit(False))


def branch_code_valid(x: Column) -> Column:
    return F.coalesce(F.upper(F.trim(x)).rlike(BRANCH), F.lit(False))


def amount_after(text: Column, label: str) -> Column:
    """The number after `label:` in a text; null where there is none."""
    return F.regexp_replace(F.regexp_extract(text, rf"{label}:\s*([0-9][0-9,]*(\.[0-9]+)?)", 1), ",", "").try_cast("double")


def city(x: Column) -> Column:
    """The usual name of a city; others have each word capitalised, blank ones are null."""
    plain = F.trim(x)
    return F.when(plain == "", None).otherwise(F.coalesce(lookup(F.lower(plain), CITY), F.initcap(plain)))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(parts)), F.lit(False))


def is_property_page(url: Column) -> Column:
    return _any(url, PROPERTY) & ~_any(url, NOT_PROPERTY)


def is_refused_page(html: Column) -> Column:
    return _any(html, REFUSED)
