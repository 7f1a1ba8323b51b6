"""What the documents of an application say together: profiles for later stages and for compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.columns import present, rounded
from loanloom.operators.documents import matched, with_dashes

#: The fields that a profile reads, by class.
READ = {
    "PAN_CARD": ("full_name", "pan_number"), "AADHAAR_CARD": ("full_name", "aadhaar_number", "address"), "SALARY_SLIP": ("employee_name", "gross_salary", "net_salary"),
    "FORM_16": ("gross_salary",), "BANK_STATEMENT": ("account_number",), "PROPERTY_DEED": ("city", "property_address"),
}


def read_once(docs: DataFrame, key: str) -> DataFrame:
    """One row per document (key, filename, text, doc_class): key, _name, _class, _read and the READ fields of its class, prefixed by
    the class. Each text is in the column of its class alone; patterns find nothing in those without one."""
    of = {kind: F.when(F.col("doc_class") == kind, F.col("text")).alias(f"_{kind}") for kind in READ}
    texts = docs.select(key, F.col("filename").alias("_name"), F.col("doc_class").alias("_class"), (F.col("text") != "").alias("_read"), *of.values())
    found = {(kind, n): matched(kind, F.col(f"_{kind}"))[n] for kind, names in READ.items() for n in names}
    return texts.select(key, "_name", "_class", "_read", *[v.alias(f"{kind.lower()}_{n}") for (kind, n), v in found.items()])


def profiles(docs: DataFrame, key: str = "application_id") -> DataFrame:
    """Of classified documents (key, filename, text, doc_class): the applicant's name (of the PAN card, else the
    Aadhaar card, else a slip), numbers, mean gross and net pay over the slips (else a twelfth of form 16), and what
    the documents leave open. Of a class with several documents the last by file name counts, of slips all."""
    is_slip = F.col("_class") == "SALARY_SLIP"
    of_slip = lambda n: F.when(is_slip, F.col(f"salary_slip_{n}"))
    slips = [F.nullif(F.count_if(is_slip), F.lit(0)).alias("n_slips"), F.min(of_slip("employee_name")).alias("slip_name"), F.avg(of_slip("gross_salary")).alias("gross"), F.avg(of_slip("net_salary")).alias("net")]
    last = [F.max_by(F.struct(*[f"{kind.lower()}_{n}" for n in names]), F.when(F.col("_class") == kind, F.col("_name"))).alias(kind) for kind, names in READ.items() if kind != "SALARY_SLIP"]
    # documents are few to an application: all of one go to one task before they are grouped, and only what was read of them
    rows = read_once(docs, key).repartition(key)
    df = rows.groupBy(key).agg(F.count("*").alias("n_documents"), F.count_if("_read").alias("n_read"), *last, *slips)
    df = df.select(key, "n_documents", "n_read", "n_slips", "slip_name", "gross", "net", *[F.col(f"{kind}.{kind.lower()}_{n}") for kind, names in READ.items() if kind != "SALARY_SLIP" for n in names])
    df = df.withColumn("aadhaar_card_aadhaar_number", with_dashes(F.col("aadhaar_card_aadhaar_number")))
    c = F.col
    pan, aadhaar = c("pan_card_pan_number").isNotNull(), c("aadhaar_card_aadhaar_number").isNotNull()
    gross = F.coalesce("gross", c("form_16_gross_salary") / 12.0, F.lit(0.0))
    missing = F.size(present((~pan, "pan"), (~aadhaar, "aadhaar"), (c("n_slips").isNull() & c("form_16_gross_salary").isNull(), "income"), (c("bank_statement_account_number").isNull(), "statement"), (c("property_deed_property_address").isNull(), "property")))
    status = F.when(c("n_read") == c("n_documents"), "verified").otherwise("partial")
    return df.select(key, F.coalesce("pan_card_full_name", "aadhaar_card_full_name", "slip_name", F.lit("Applicant")).alias("primary_name"), c("pan_card_pan_number").alias("pan_number"), c("aadhaar_card_aadhaar_number").alias("aadhaar_number"), rounded(gross, 2).alias("monthly_gross"), rounded(F.coalesce("net", F.lit(0.0)), 2).alias("monthly_net"), F.coalesce("n_slips", F.lit(0)).alias("n_slips"),
        c("property_deed_city").alias("property_city"), status.alias("verification_status"), missing.alias("n_missing"), F.array_join(present((missing > 0, "missing_documents"), (~(pan & aadhaar), "incomplete_kyc")), ",").alias("flags"),
        # what compliance asks of the documents
        pan.alias("pan_present"), aadhaar.alias("aadhaar_present"), c("aadhaar_card_address").isNotNull().alias("address_present"), (c("n_slips").isNotNull() | c("form_16_gross_salary").isNotNull() | c("bank_statement_account_number").isNotNull()).alias("source_of_funds_declared"), (pan & aadhaar).alias("identity_verification_logged"))
