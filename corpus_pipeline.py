"""A training-text pipeline: language ID, line dedup, near dedup, decontamination, BPE.

Each stage works on every row that its predecessor kept, and all columns of documents pass through to the last one.

Defined results: rows whose text is null, empty or has no letter are rejected by the first stage; an empty table stays
empty. Rows that share a doc_id are judged by their own texts; repeated rows lose all but one to near dedup. Extra
columns, also with names that a stage uses inside, are kept as they are. Long texts are read whole. Of a group of near
copies the row with the smallest doc_id stays. The last stage gives doc_id, n_tokens and ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from loanloom.llm.cluster import documents, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language isn't recognised; lang is the predicted one."""
    return language_id.keep_known(docs, language_id.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each repeated line to the smallest doc_id; n_chars follows the text."""
    found = line_dedup.without_repeats(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 80 % of five-word shingles."""
    return near_dedup.one_of_each(docs, words=5, percent=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a passage of the benchmark."""
    return decontaminate.without_benchmark(docs, decontaminate.benchmark(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens and the ids (little-endian unsigned 32-bit) of every text. The ids are
    decoded again; a text that doesn't come back as it was stops the run."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # the digest of the text travels with the id
    coded = byte_bpe.round_trip(docs.select(F.struct("doc_id", digest.alias("sha256")).alias("doc_id"), "text"))
    lossless = digest == F.col("doc_id.sha256")
    ids = F.when(lossless, F.col("ids")).otherwise(F.raise_error(F.lit("decoded text differs from the text encoded")).cast("binary"))
    coded = coded.select(F.col("doc_id.doc_id").alias("doc_id"), ids.alias("ids"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", languages), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmarks), ("byte_bpe", tokens)]

#: The language network, the near-dedup components and the merges of BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
