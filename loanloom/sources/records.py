"""Readers and sinks of application exports, labelled cases, predictions, listings, audit logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators.listings import scored
from loanloom.operators.texts import city

#: What a stored application holds as JSON, as far as reports read it.
_CREDIT = "struct<credit_band: string, risk_score: double, confidence: double, preliminary_decision: string, cibil_score: int, flags: array<string>>"
_DECISION = "struct<decision: string, risk_score: double, confidence: double, gate_triggered: string>"
VIEW = f"id string, created_at string, gender string, agents struct<credit: {_CREDIT}, decision: {_DECISION}>, decision {_DECISION}"
EXPORT = "id string, created_at string, view string, gender string, outcome_bad int"


def rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The records of a JSON export: an array, one object (also over several lines) or one object a line. A byte
    order mark is ignored. The first line that isn't blank decides how the file is read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], schema)
    head = first["value"].strip()
    if head.startswith("[") or (head.startswith("{") and not head.endswith("}")):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    shape = spark.createDataFrame([], schema).schema
    return lines.select(F.from_json("value", shape).alias("r")).select("r.*")


def normalised(exported: DataFrame) -> DataFrame:
    """Exported rows as flat records: the JSON of view is parsed once, the decision of agents goes before the one
    beside them, and columns of the row before those inside it. Rows without a view keep what they have."""
    v = F.from_json("view", VIEW)
    df = exported.withColumn("v", v)
    has = lambda name: name in exported.columns
    own = lambda name: F.coalesce(F.col(name) if has(name) else F.lit(None), F.col(f"v.{name}"))
    decision = F.coalesce("v.agents.decision", "v.decision")
    return df.select(own("id").alias("application_id"), own("created_at").alias("created_at"), own("gender").alias("gender"), F.col("v.agents.credit").alias("credit"), decision.alias("decision"), *[F.col(n) for n in ("outcome_bad", "field_overrides") if has(n)])


def exported(applications: DataFrame, documents: DataFrame) -> DataFrame:
    """applications with gender, from the first identity document that states one, and field_overrides: what
    reviewers corrected in each readable document, empty where nothing, null where no document could be read.
    documents: application_id, doc_id, doc_type, gender, readable, overrides (array of field names)."""
    c = F.col
    found = documents.groupBy("application_id").agg(
        F.min_by(F.when(c("doc_type") == "AADHAAR_CARD", c("gender")), F.when((c("doc_type") == "AADHAAR_CARD") & c("gender").isNotNull(), c("doc_id"))).alias("gender"),
        F.collect_list(F.when(c("readable"), F.struct("doc_id", F.coalesce("overrides", F.array().cast("array<string>")).alias("fields")))).alias("o"),
    )
    overrides = F.when(F.size("o") > 0, F.map_from_entries(F.array_sort("o")))
    return applications.join(found.select("application_id", "gender", overrides.alias("field_overrides")), "application_id", "left")


def cases(spark: SparkSession, path: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Labelled cases of a JSON file, a bare list or an object with cases or labeled_cases, with their place; and
    the places of those without an application_id or label, which are left out. item: the schema of one."""
    shape = f"cases array<struct<{item}>>, labeled_cases array<struct<{item}>>"
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head is not None and head["value"].strip().lstrip("﻿").startswith("["):
        each = spark.read.schema(", ".join(x.replace(": ", " ", 1) for x in item.split(", "))).option("multiLine", True).json(path)
        each = each.select(F.monotonically_increasing_id().alias("place"), *each.columns)
    else:
        whole = spark.read.schema(shape).option("multiLine", True).json(path)
        each = whole.select(F.posexplode(F.coalesce("cases", "labeled_cases")).alias("place", "x")).select("place", "x.*")
    good = F.col("application_id").isNotNull() & F.col("ground_truth_decision").isNotNull()
    return each.where(good), each.where(~good).select("place", "application_id")


def last_of_each(predictions: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by order."""
    return predictions.groupBy(key).agg(F.max_by(F.struct(*[n for n in predictions.columns if n != key]), order).alias("r")).select(key, "r.*")


def predicted(labelled: DataFrame, predictions: DataFrame, key: str = "application_id") -> tuple[DataFrame, DataFrame]:
    """Cases with their own prediction, else the one of the table; and the keys of those that have neither."""
    given = predictions.select(key, F.col("decision").alias("_given"))
    df = labelled.join(given, key, "left").withColumn("predicted", F.coalesce("predicted", "_given")).drop("_given")
    return df.where("predicted is not null"), df.where("predicted is null").select(key)


#: Columns of a listing file and what they become.
LISTING_COLUMNS = {"source_platform": "source", "listing_url": "source_url", "state": "state", "city": "city", "locality": "locality", "property_type": "property_type", "bhk": "bedrooms", "bathrooms": "bathrooms", "area_sqft": "area_sqft", "price_inr": "price_inr", "price_per_sqft": "price_per_sqft", "floor_number": "floor", "total_floors": "total_floors", "parking_spaces": "parking"}
_WHOLE = ("bedrooms", "bathrooms", "floor", "total_floors", "parking")
_REAL = ("area_sqft", "price_inr", "price_per_sqft")


def whole(text: Column) -> Column:
    """A 32-bit integer from a number text, cut to whole; null for what is none or out of range."""
    x = text.try_cast("double")
    return F.when(x.between(-2147483648.0, 2147483647.0) & ~F.isnan(x), x.cast("int"))


def listing_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a listing CSV with a header, all columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def mapped(raw: DataFrame) -> DataFrame:
    """Rows of a listing file in the shape of the listing table, with usual names of cities and kinds, and scored.
    Columns that the file lacks are null."""
    text = lambda name: F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in raw.columns else F.lit(None).cast("string")
    cast = {**{n: whole for n in _WHOLE}, **{n: (lambda x: x.try_cast("double")) for n in _REAL}}
    df = raw.select(*[cast.get(new, lambda x: x)(text(old)).alias(new) for old, new in LISTING_COLUMNS.items()])
    low = F.initcap(F.trim("property_type"))
    has = lambda *parts: F.array_contains(F.array(*[F.contains(low, F.lit(p)) for p in parts]), True)
    kind = F.when(has("Apartment", "Flat"), "Apartment").when(has("Villa"), "Villa").when(has("House", "Independent"), "Independent House").when(has("Plot", "Land"), "Plot").otherwise(F.col("property_type"))
    none = {n: F.lit(None) for n in ("furnishing", "property_age", "pincode", "listing_age_days")}
    df = df.withColumns({"source": F.coalesce("source", F.lit("unknown")), "city": city(F.col("city")), "property_type": kind, "transaction_type": F.lit("Sale")} | none)
    return scored(df)


def replaceable(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings that may replace the table (those with locality and price), and how many were imported and skipped."""
    good = F.coalesce(F.trim("locality") != "", F.lit(False)) & F.coalesce(F.col("price_inr") > 0, F.lit(False))
    return listings.where(good), listings.agg(F.count_if(good).alias("imported"), F.count_if(~good).alias("skipped"))


def purged(listings: DataFrame, bad_ids: tuple[int, ...], demo: str = "demo_source") -> tuple[DataFrame, DataFrame]:
    """listings without bad ids and the demo source, and how many of each went; a row with both counts as bad."""
    bad = F.coalesce(F.col("listing_id").isin(*bad_ids), F.lit(False))
    shown = F.coalesce(F.col("source") == demo, F.lit(False))
    return listings.where(~bad & ~shown), listings.agg(F.count_if(bad).alias("bad_ids"), F.count_if(~bad & shown).alias("demo_rows"))


def saved(stored: DataFrame, batch: DataFrame, key: str = "application_id", order: str = "saved_at") -> DataFrame:
    """The application table after saving batch: the newest row of each key, of stored and batch rows alike."""
    both = stored.unionByName(batch)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def as_view(staged: DataFrame) -> DataFrame:
    """application_id, scalar columns and the whole application as JSON."""
    inner = F.struct(F.struct(F.struct("credit_band", "preliminary_decision").alias("credit"), F.struct("decision", F.col("gate").alias("gate_triggered")).alias("decision")).alias("agents"))
    return staged.select("application_id", "decision", F.to_json(inner).alias("view"))


def append_audit(log: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends records to the audit log, partitioned by day."""
    log.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def audit(spark: SparkSession, path: str, application_id: object | None = None) -> DataFrame:
    """The audit log, or that of one application."""
    log = spark.read.parquet(path)
    return log if application_id is None else log.where(F.col("application_id") == F.lit(application_id))


def save_scores(records: DataFrame, score: str, path: str) -> None:
    """Writes the scores that later batches are compared with."""
    records.where(F.col(score).isNotNull()).select(score).write.mode("overwrite").parquet(path)


def save_report(report: DataFrame, path: str) -> str:
    """Writes a small report (rows of an aggregation) as JSON lines in one file and gives it as a Markdown table."""
    report.coalesce(1).write.mode("overwrite").json(path)
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in report.collect()]
    return "\n".join(lines)
