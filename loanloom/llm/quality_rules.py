"""Quality rules by cross-document line frequency; DataFrame functions only.

Lines are normalised (outer white space off, lower-cased, runs of white space one space) and hashed; for
each host the distinct documents of each hash are counted. Lines in least_docs documents of their host or more are
removed if these are more than limit_share of the host's documents, or more than limit_docs (for hosts so large that boilerplate
is a small share of them). A document is rejected when less than least_words words or least_share of its words are left. Simple
rules on the text come first.

How it scales: the first pass aggregates (host, hash) before its shuffle. Only lines above the limits are
joined back, each of which stands in least_docs documents at least; they are broadcast up to
BROADCAST_BYTES, beyond it the join is shuffled and adaptive execution splits hot keys. Repeated words are
found within the row: no word ever leaves its document.

Defined results: null text has no words. Null hosts are one host. Every row is a document, so repeated
rows count each. Blank lines aren't counted. A line at a limit stays, only one above it goes. Very long texts are judged whole,
within their row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.cluster import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
LEAST_DOCS = 5
LIMIT_DOCS = 1000
LIMIT_SHARE = 0.02
LEAST_SHARE = 0.3
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice; windows: the hash at each place."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(rows: Column) -> Column:
        own = lambda k: F.get(rows, k)["h"]
        twice = F.filter(rows, lambda r, k: (own(k - 1) == r["h"]) | (own(k + 1) == r["h"]))
        return F.sort_array(F.transform(twice, lambda r: r["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - i), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    # one-element arrays bind a value once
    found = F.transform(F.array(ranked), lambda rows: places(rows))
    return F.get(F.transform(found, lambda at: covered(at)), 0)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, source, lines and the figures of the base rules of each row, with a number of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", "source", "text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"), F.split("text", "\n").alias("lines"))
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))
    rows = rows.select("*", windows.alias("windows"), F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("worded"))
    return rows.select(
        "row", "doc_id", "source", "worded",
        F.size("hashes").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(repeated_words(F.col("windows"))).alias("n_repeat_words"),
    )


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def frequent_lines(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """host, line hash and number of documents of the lines in least_docs documents or more and above either limit."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.xxhash64(normalised(x)))
    each = docs.select(F.coalesce("source", F.lit("")).alias("host"), F.explode(F.array_distinct(lines)).alias("hash"))
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    hosts = docs.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count("*").alias("of_host"))
    above = (F.col("n_docs") > limit_share * F.col("of_host")) | (F.col("n_docs") > limit_docs)
    return counts.join(hosts, "host").where(above).select("host", "hash", "n_docs")


def judged(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per row: doc_id, the base figures, base_failed, n_removed_lines, n_left_words and kept."""
    docs = docs.select(docs["doc_id"], docs["source"], docs["text"])
    frequent = written(frequent_lines(docs, limit_docs, limit_share), "frequent-lines")
    near = frequent.select(F.col("host").alias("at_host"), F.col("hash").alias("at_hash"))
    if frequent.count() * 32 <= BROADCAST_BYTES:
        near = F.broadcast(near)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    one = lambda x: F.struct(F.xxhash64(normalised(x)).alias("hash"), F.size(words_of(x)).alias("n"))
    rows = base(docs).select("row", "doc_id", "source", *figures, F.explode_outer(F.transform("worded", one)).alias("line"))
    rows = rows.join(near, (F.coalesce("source", F.lit("")) == F.col("at_host")) & (F.col("line.hash") == F.col("at_hash")), "left")
    gone = F.col("at_hash").isNotNull()
    found = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.max(c).alias(c) for c in figures],
        F.count_if(gone).alias("n_removed_lines"),
        F.coalesce(F.sum(F.when(gone, F.col("line.n"))), F.lit(0)).alias("removed_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < least_words) | (left < least_share * F.col("n_words"))
    return found.select("doc_id", *figures, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_lines", left.alias("n_left_words"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))}) AS g, lead(w, 7) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE whole) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS t(k) GROUP BY r),
counted AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, host, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d)),
hosts AS (SELECT host, count(*) AS of_host FROM d GROUP BY host),
freq AS (SELECT l.host, norm FROM l JOIN hosts USING (host) GROUP BY l.host, norm, of_host HAVING count(DISTINCT r) >= {LEAST_DOCS} AND (count(DISTINCT r) > CAST({LIMIT_SHARE} AS DOUBLE) * of_host OR count(DISTINCT r) > {LIMIT_DOCS})),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE worded GROUP BY r),
gone AS (SELECT r, count(*) AS n_removed_lines, sum(n) AS removed FROM l JOIN freq USING (host, norm) WHERE worded GROUP BY r),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, CAST(coalesce(n_words, 0) - coalesce(removed, 0) AS BIGINT) AS n_left_words
  FROM d LEFT JOIN counted USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AND n_left_words >= {LEAST_WORDS} AND n_left_words >= CAST({LEAST_SHARE} AS DOUBLE) * n_words AS kept, n_removed_lines, n_left_words
FROM f
"""
