"""Listings and registered projects from stored HTML pages, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators.listings import price

if TYPE_CHECKING:
    import pyarrow as pa

#: Where pages keep structured data, later ones going over earlier ones.
BLOCKS = (
    r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>",
    r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>",
    r"(?is)<script[^>]*>[^<]*window\.__NUXT__\s*=\s*(\{.*?\})\s*;?\s*</script>",
)
#: What listings need of it: name and place in the JSON.
PATHS = {"locality": "$.address.addressLocality", "pincode": "$.address.postalCode", "price_text": "$.offers.price"}
#: Attributes in page text.
ATTRIBUTES = {"bathrooms": r"(?i)([0-9]+)\s*Bath", "floor": r"(?i)Floor\s*[:#]?\s*([0-9]+)", "total_floors": r"(?i)(?:Total\s+Floors?|Floors?)\s*[:#]?\s*([0-9]+)", "property_age": r"(?i)(?:Age|Property\s+Age)\s*[:#]?\s*([0-9]+)", "parking": r"(?i)([0-9]+)\s*(?:Car\s+)?Parking"}
CONFIGURATION = r"(?is)([0-9]+)\s*BHK.*?([0-9,.]+)\s*(?:sq\.?\s*ft|sqft|sq\.?\s*feet).*?(₹\s*[0-9,.]+\s*(?:Cr|Crore|Lac|Lakhs|Lakh))"
PIN = r"\b([0-9]{6})\b"
#: The number of a registered project and its fields.
PROJECT = r"[A-Z]+/[A-Z]+/RERA/[0-9]+/[0-9]+/[A-Z]+/[0-9]+/[0-9]+"
PROJECT_FIELDS = {"project_name": r"(?i)Project Name\s*:\s*([^\n<]+)", "builder_name": r"(?i)Builder\s*:\s*([^\n<]+)", "city": r"(?i)City\s*:\s*([^\n<]+)", "locality": r"(?i)Locality\s*:\s*([^\n<]+)", "total_units": r"(?i)Total Units\s*:\s*([0-9]+)", "area_sqft": r"(?i)Area\s*:\s*([0-9]+)", "approval_date": r"(?i)Approval Date\s*:\s*([^\n<]+)", "completion_date": r"(?i)Completion Date\s*:\s*([^\n<]+)"}


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags are spaces, and so are runs of white space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))


def structured(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the fields of PATHS from all structured blocks of a page; of several the last counts, by kind and then
    by place. What is no JSON has no fields. Pages without any have nulls."""
    blocks = F.concat(*[F.coalesce(F.regexp_extract_all("html", F.lit(p), F.lit(1)), F.array().cast("array<string>")) for p in BLOCKS])
    df = pages.select(key, blocks.alias("blocks"))
    last = lambda path: F.element_at(F.filter(F.transform("blocks", lambda b: F.get_json_object(b, path)), lambda v: v.isNotNull()), -1)
    some = lambda path: F.when(F.size(F.filter(F.transform("blocks", lambda b: F.get_json_object(b, path)), lambda v: v.isNotNull())) > 0, last(path))
    return df.select(key, F.size("blocks").alias("n_blocks"), *[some(path).alias(name) for name, path in PATHS.items()])


def attributes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and what a page's text says of a flat: bedrooms, area and price of the first configuration with all three,
    postal code, furnishing and the numbers of ATTRIBUTES."""
    t = F.col("t")
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("int")
    furnished = F.when(t.rlike(r"\b[Ff]urnished\b"), F.when(t.rlike(r"\b[Ss]emi[-\s]?[Ff]urnished\b"), "Semi-Furnished").when(t.rlike(r"\b[Uu]nfurnished\b"), "Unfurnished").otherwise("Furnished"))
    df = pages.select(key, page_text(F.col("html")).alias("t"))
    return df.select(key, F.regexp_extract(t, CONFIGURATION, 1).try_cast("int").alias("bedrooms"), F.regexp_replace(F.regexp_extract(t, CONFIGURATION, 2), ",", "").try_cast("double").alias("area_sqft"), price(F.nullif(F.regexp_extract(t, CONFIGURATION, 3), F.lit(""))).alias("price_inr"),
        _first(t, PIN).alias("pincode"), furnished.alias("furnishing"), *[number(p).alias(n) for n, p in ATTRIBUTES.items()])


def json_chunks(text: Column) -> Column:
    """The outermost {...} parts of a text, by the depth of its braces; the whole text where there is none. That takes
    objects out of arrays and parts objects that follow each other."""
    at = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("pos"), F.lit(0).alias("start"), F.array().cast("array<struct<s:int,n:int>>").alias("spans"))

    def step(a: Column, token: Column) -> Column:
        depth = a["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        opens = (token == "{") & (a["depth"] == 0)
        ends = (token == "}") & (depth == 0) & (a["start"] > 0)
        span = F.array(F.struct(a["start"].alias("s"), (a["pos"] + 1 - a["start"]).alias("n")))
        start = F.when(opens, a["pos"]).when(ends, 0).otherwise(a["start"])
        return F.struct(depth.alias("depth"), (a["pos"] + F.char_length(token)).alias("pos"), start.alias("start"), F.when(ends, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate(F.regexp_extract_all(text, F.lit(r"[{}]|[^{}]+"), F.lit(0)), at, step, lambda a: a["spans"])
    return F.when(F.contains(text, F.lit("{")) & (F.size(spans) > 0), F.transform(spans, lambda x: F.substring(text, x["s"], x["n"]))).otherwise(F.array(text))


def deep_merge(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: replaces the columns after the first width ones, arrays of JSON texts, by all their objects merged
    into one JSON text. Of a key that both have, objects are merged, and anything else of the later one replaces what the
    earlier one has; texts that are no JSON object are passed over. Of all arrays but the first only the first object
    counts. SQL functions can't merge objects of unknown depth, hence this helper of Arrow batches."""

    def run(batches):
        import json

        import pyarrow as pa

        def put(base, more):
            for key, value in more.items():
                if isinstance(base.get(key), dict) and isinstance(value, dict):
                    put(base[key], value)
                else:
                    base[key] = value

        def objects(texts):
            for text in texts or ():
                try:
                    found = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                yield from [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]

        for batch in batches:
            out = []
            for all_, *firsts in zip(*(batch.column(k).to_pylist() for k in range(width, batch.num_columns)), strict=True):
                whole = {}
                for found in [*objects(all_), *(x for texts in firsts for x in [*objects(texts)][:1])]:
                    put(whole, found)
                out.append(json.dumps(whole, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.string())], [*batch.schema.names[:width], "data"])

    return run


def merged_data(pages: DataFrame, *keys: str) -> DataFrame:
    """keys (page_id), n_chunks (of linked data) and data: all structured data of a page as one JSON object. Chunks of linked data come
    first, in the order of the page, then the first object of each of the two other kinds. Pages without any have {}."""
    blocks = [F.coalesce(F.regexp_extract_all("html", F.lit(p), F.lit(1)), F.array().cast("array<string>")) for p in BLOCKS]
    keys = keys or ("page_id",)
    df = pages.select(*keys, F.filter(F.transform(blocks[0], lambda b: F.trim(b)), lambda b: b != "").alias("linked"), blocks[1].alias("next"), blocks[2].alias("nuxt"))
    df = df.withColumn("chunks", F.flatten(F.transform("linked", json_chunks)))
    df = df.select(*keys, F.size("chunks").alias("n_chunks"), "chunks", "next", "nuxt")
    kept = T.StructType([*df.schema[: len(keys) + 1], T.StructField("data", T.StringType())])
    return df.mapInArrow(deep_merge(len(keys) + 1), kept)


def configurations(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, place, bedrooms, area_sqft and price_inr: one row for each configuration in a page's text that has all three, in
    the order of the page. A match starts after the one before it."""
    t = F.col("t")
    group = lambda k: F.regexp_extract_all(t, F.lit(CONFIGURATION), F.lit(k))
    df = pages.select(key, page_text(F.col("html")).alias("t")).select(key, F.arrays_zip(group(1).alias("bhk"), group(2).alias("area"), group(3).alias("price")).alias("found"))
    df = df.select(key, F.posexplode_outer("found").alias("place", "x")).where("x is not null")
    df = df.select(key, (F.col("place") + 1).alias("place"), F.col("x.bhk").try_cast("int").alias("bedrooms"), F.regexp_replace("x.area", ",", "").try_cast("double").alias("area_sqft"), price(F.col("x.price")).alias("price_inr"))
    return df.where("area_sqft > 0 and price_inr > 0")


#: Where a page without structured data names its locality, in this order.
META = r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']"
IN_META = r"\bin\s+([A-Z][A-Za-z\s]+?)(?:,|\s*-|\s*$)"
CRUMBS = r"(?is)<nav[^>]*>(.*?)</nav>|<(?:div|ul|ol|p|span)[^>]*class=[\"'][^\"']*\bbreadcrumb\b[^\"']*[\"'][^>]*>(.*?)</(?:div|ul|ol|p|span)>"
ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a>"
IN_CRUMB = r"(?i)(?:Projects?|Properties?)\s+in\s+(.+)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
IN_TITLE = r"(?:in|at)\s+([A-Z][A-Za-z\s]+?)(?:,|\s*-|\s*\||$)"


def localities(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, locality and found_in: by the structured data's address, else the description, else a link of the page's trail,
    else the title; null where none names one."""
    h = F.col("html")
    part = lambda text, pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    trails = F.concat(F.regexp_extract_all(h, F.lit(CRUMBS), F.lit(1)), F.regexp_extract_all(h, F.lit(CRUMBS), F.lit(2)))
    links = F.flatten(F.transform(trails, lambda x: F.regexp_extract_all(x, F.lit(ANCHOR), F.lit(1))))
    named = F.filter(F.transform(links, lambda x: part(F.trim(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]*>", " "), r"[ \t\n\r]+", " ")), IN_CRUMB)), lambda x: x.isNotNull())
    said = F.get_json_object("data", "$.address.addressLocality")
    known = F.nullif(said, F.lit(""))
    df = merged_data(pages, key, "html").select(key, known.alias("known"), part(F.regexp_extract(h, META, 1), IN_META).alias("described"), F.get(named, F.lit(0)).alias("linked"), part(F.regexp_extract(h, TITLE, 1), IN_TITLE).alias("titled"))
    where = F.when(F.col("known").isNotNull(), "data").when(F.col("described").isNotNull(), "description").when(F.col("linked").isNotNull(), "trail").when(F.col("titled").isNotNull(), "title")
    return df.select(key, F.coalesce("known", "described", "linked", "titled").alias("locality"), where.alias("found_in"))


def projects(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that name a registered project, with its fields; others are left out."""
    rows = pages.where(F.col("html").rlike(PROJECT))
    h = F.col("html")
    text = {n: (_first(h, p).try_cast("int") if n in ("total_units", "area_sqft") else _first(h, p)) for n, p in PROJECT_FIELDS.items()}
    return rows.select(key, F.regexp_extract(h, PROJECT, 0).alias("rera_number"), *[c.alias(n) for n, c in text.items()])
