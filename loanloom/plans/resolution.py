"""Queries of listing matching and of documents against each other, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.functions.lineage import cut
from loanloom.operators import benchmarks, documents, ingestion, matching, monitoring, reconcile
from loanloom.plans import documents as document_plans
from loanloom.plans.documents import AS_OF, CHAIN, slips, texts
from loanloom.plans.listings import CLEAN_SQL, clean
from loanloom.plans.sql import name_similarity, r
from loanloom.plans.validations import _MONTH

SOURCES = ("square_yards", "magicbricks", "housing")


def two(spark, sf_dir):
    """Listings of two sources."""
    df = clean(spark, sf_dir)
    return df.where("source = 'magicbricks'"), df.where("source = 'housing'")


def j07_candidates(spark, sf_dir):
    return matching.candidates(*two(spark, sf_dir))


def w07_mutual_best(spark, sf_dir):
    return matching.mutual_best(*two(spark, sf_dir))


def j08_assigned(spark, sf_dir):
    return matching.matched(*two(spark, sf_dir))


def j09_merged(spark, sf_dir):
    found = matching.merged(clean(spark, sf_dir), list(SOURCES))
    return found.select("listing_id", "source", "source_count", F.array_join("sources", ",").alias("sources"), F.array_join("imputed_fields", ",").alias("imputed_fields"), "bathrooms", "furnishing", "quality")


def l26_merged_by_city(spark, sf_dir):
    """The merge job: matched, filled and scored, then what a table of distinct urls lacks, by city."""
    found = matching.merged(clean(spark, sf_dir), list(SOURCES))
    return found.groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.col("source_count") > 1).alias("n_merged"), F.max("quality").alias("max_quality"))


def j10_merged_pair(spark, sf_dir):
    base, other = two(spark, sf_dir)
    keyed = lambda df, name: df.withColumns({"listing_id": F.floor(F.col("listing_id") / 3), "sources": F.array(F.lit(name)), "imputed_fields": F.array().cast("array<string>")}).dropDuplicates(["listing_id"])
    # one listing of each group of three ids
    first = lambda df: df.groupBy(F.floor(F.col("listing_id") / 3).alias("g")).agg(F.min("listing_id").alias("listing_id")).select("listing_id")
    a, b = base.join(first(base), "listing_id"), other.join(first(other), "listing_id")
    found = matching.merged_pair(keyed(a, "magicbricks"), keyed(b, "housing"))
    return found.select("listing_id", "bathrooms", "furnishing", "parking", F.array_join("sources", ",").alias("sources"), "source_count", F.array_join("imputed_fields", ",").alias("imputed_fields"))


def t04_largest_source(spark, sf_dir):
    return matching.largest_source(clean(spark, sf_dir))


@once
def pairs(spark, sf_dir):
    return reconcile.name_pairs(view(spark, sf_dir, "named_documents"))


def checks(spark, sf_dir):
    return view(spark, sf_dir, "document_checks")


def employers(spark, sf_dir):
    return reconcile.employers(checks(spark, sf_dir), "slip_employer", "form_employer")


def payslips(spark, sf_dir):
    """The payslips read from document texts; the tables hold one an application."""
    return slips(spark, sf_dir).withColumn("place", F.lit(1))


@once
def incomes(spark, sf_dir):
    statements = texts(spark, sf_dir, "BANK_STATEMENT")
    return reconcile.incomes(payslips(spark, sf_dir), reconcile.salary_credits(statements, documents.transactions(statements)))


def j04_incomes(spark, sf_dir):
    """Net pay of payslips against the salary credits of statements, both read from document texts."""
    return incomes(spark, sf_dir).drop("place")


@once
def disputed(spark, sf_dir):
    """What each application's documents say against each other: name pairs, employers and incomes are worked out once."""
    return reconcile.compared(pairs(spark, sf_dir), employers(spark, sf_dir), incomes(spark, sf_dir))


def j03_contradictions(spark, sf_dir):
    """Each contradiction of each application's documents, in order."""
    return disputed(spark, sf_dir).select("application_id", F.posexplode("contradictions").alias("place", "contradiction"))


def j03_name_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


def j05_employers(spark, sf_dir):
    return employers(spark, sf_dir)


def j06_addresses(spark, sf_dir):
    return reconcile.addresses(checks(spark, sf_dir))


@once
def scored(spark, sf_dir):
    """The checks of all applications with what their documents say against each other."""
    own = checks(spark, sf_dir).drop("n_other")  # the fixture's count; that of the texts counts here
    return reconcile.reconciled(own.join(disputed(spark, sf_dir), "application_id", "left"))


def a54_reconciliation(spark, sf_dir):
    return scored(spark, sf_dir).select("application_id", "n_contradictions", "reconciliation_score")


@once
def trusted(spark, sf_dir):
    return reconcile.ingestion_confidence(scored(spark, sf_dir))


def v08_missing_documents(spark, sf_dir):
    return checks(spark, sf_dir).select("application_id", F.array_join(reconcile.missing_documents(F.col), "; ").alias("missing"))


def a55_ingestion_confidence(spark, sf_dir):
    return trusted(spark, sf_dir).select("application_id", "ocr_quality", F.round("field_validation", 3).alias("field_validation"), "reconciliation_score", "completeness", "overall_confidence", "confidence_level")


@once
def routed(spark, sf_dir):
    faults = reconcile.slip_faults(payslips(spark, sf_dir), AS_OF)
    kept = (F.col("has_contradiction"), F.size("missing_documents").alias("lacks"))
    return reconcile.review_routing(trusted(spark, sf_dir).join(faults, "application_id", "left"), *kept)


def a56_review_routing(spark, sf_dir):
    return routed(spark, sf_dir).select("application_id", "requires_human_review", "priority", F.array_join("reasons", "; ").alias("reasons"), F.array_join("actions", "; ").alias("actions"))


def a10_operational(spark, sf_dir):
    return reconcile.operational(routed(spark, sf_dir))


def a10_gate_triggers(spark, sf_dir):
    return reconcile.gate_triggers(routed(spark, sf_dir))


def a38_reconciliation_quality(spark, sf_dir):
    found = checks(spark, sf_dir).withColumn("predicted_contradiction", F.col("n_other") > 0)
    return reconcile.quality(found)


def a46_ingestion_report(spark, sf_dir):
    """The whole ingestion report: classes, cost of confusions, confidence against right routing, contradictions,
    runtime figures and gates. An application is routed rightly where people see it if and only if it is known to
    hold a contradiction or lacks a document."""
    right = F.col("requires_human_review") == (F.col("has_contradiction") | (F.col("lacks") > 0))
    each = F.transform("reasons", reconcile.gate_of)
    # five sections read it: worked out once
    found = cut(routed(spark, sf_dir).select("overall_confidence", "requires_human_review", right.alias("right"), each.alias("each")))
    gates = found.select(F.explode("each").alias("gate"))
    counted = cut(document_plans.called(spark, sf_dir))
    sections = {
        "classification": ingestion.class_summary(counted, document_plans.LABELS, "n"), "cost": ingestion.class_cost(counted, "n"), "brier": monitoring.brier(found, "overall_confidence", "right"),
        "calibration": monitoring.calibration_error(found, "overall_confidence", "right"), "gate": monitoring.gate_error(found, "overall_confidence", "right", reconcile.PASSES),
        "reconciliation": a38_reconciliation_quality(spark, sf_dir), "operational": reconcile.operational(found),
        "gates": gates.agg(*[F.count_if(F.col("gate") == g).alias(g) for g in reconcile.GATES]),
    }
    return benchmarks.report(sections)


QUERIES = {
    f.__name__: f
    for f in (j07_candidates, w07_mutual_best, j08_assigned, j09_merged, l26_merged_by_city, j10_merged_pair, t04_largest_source, j03_name_pairs, j03_contradictions, j04_incomes, j05_employers, j06_addresses, a54_reconciliation,
              v08_missing_documents, a55_ingestion_confidence, a56_review_routing, a10_operational, a10_gate_triggers, a38_reconciliation_quality, a46_ingestion_report)
}

_PLAIN = "nullif(regexp_replace(regexp_replace(trim(lower(locality)), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '')"
_SIDES = f"SELECT *, {_PLAIN} AS plain FROM clean"
_BOTH, _ROOMS = "a.plain IS NOT NULL AND b.plain IS NOT NULL", "a.bedrooms IS NOT NULL AND b.bedrooms IS NOT NULL"
_RATIO = "CASE WHEN a.{0} > 0 AND b.{0} > 0 THEN least(a.{0}, b.{0}) / greatest(a.{0}, b.{0}) END".format
_WORDS = "len(list_intersect(string_split(a.plain, ' '), string_split(b.plain, ' '))) / greatest(len(list_distinct(string_split(a.plain, ' '))), len(list_distinct(string_split(b.plain, ' '))))::DOUBLE * 0.3::DOUBLE"
_PARTS = (
    (f"CASE WHEN {_BOTH} THEN CASE WHEN a.plain = b.plain THEN 1 WHEN contains(a.plain, b.plain) OR contains(b.plain, a.plain) THEN 0.7::DOUBLE ELSE {_WORDS} END END", 0.5), (_RATIO("area_sqft"), 0.25),
    (f"CASE WHEN {_ROOMS} THEN CASE WHEN a.bedrooms = b.bedrooms THEN 1 WHEN abs(a.bedrooms - b.bedrooms) = 1 THEN 0.3::DOUBLE ELSE 0 END END", 0.15), (_RATIO("price_inr"), 0.1),
)
_TOTAL = " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for s, w in _PARTS)
_SUM = " + ".join(f"coalesce(({s}) * {w}::DOUBLE, 0)" for s, w in _PARTS)
_SCORE = r(f"({_SUM}) / nullif({_TOTAL}, 0) * CASE WHEN {_ROOMS} AND a.bedrooms <> b.bedrooms THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN {_BOTH} AND a.plain <> b.plain THEN 0.6::DOUBLE ELSE 1 END", 3)
_CANDIDATES = f"SELECT * FROM (SELECT a.listing_id AS a, b.listing_id AS b, coalesce({_SCORE}, 0) AS score FROM (SELECT * FROM sides WHERE source = 'magicbricks') a JOIN (SELECT * FROM sides WHERE source = 'housing') b ON a.city = b.city) WHERE score >= 0.6::DOUBLE"


def _l(sql):
    return oracle(sql, "raw_listings", clean=CLEAN_SQL, sides=_SIDES, candidates=_CANDIDATES)


_RANK = "list_position(['PAN Card', 'Aadhaar Card', 'Salary Slip', 'Form 16', 'Bank Statement', 'Property Deed'], document)"
_NAMED = f"SELECT application_id, document, {_RANK} AS place, min(name) AS name FROM named_documents WHERE {_RANK} > 0 AND coalesce(name, '') <> '' GROUP BY 1, 2, 3"
_NOTES = """CASE WHEN similarity >= 0.95::DOUBLE THEN concat('Names match closely between ', document_1, ' (''', name_1, ''') and ', document_2, ' (''', name_2, ''').')
 WHEN similarity >= 0.8::DOUBLE THEN concat('Minor spelling or name format difference between ', document_1, ' (''', name_1, ''') and ', document_2, ' (''', name_2, ''').')
 ELSE concat('Significant name mismatch: ''', name_1, ''' (', document_1, ') vs ''', name_2, ''' (', document_2, ').') END"""
_BOTH_NAMES = """SELECT a.application_id, a.document AS document_1, a.name AS name_1, b.document AS document_2, b.name AS name_2
 FROM named a JOIN named b ON a.application_id = b.application_id AND a.place < b.place"""
_PAIRS = f"""SELECT application_id, document_1, name_1, document_2, name_2, similarity,
 CASE WHEN similarity >= 0.95::DOUBLE THEN 'EXACT_MATCH' WHEN similarity >= 0.8::DOUBLE THEN 'FUZZY_MATCH' ELSE 'MISMATCH' END AS status, {_NOTES} AS notes
 FROM ({name_similarity(_BOTH_NAMES, "name_1", "name_2")})"""
_SHORT = "(contains(lower(slip_employer), 'tcs') AND contains(lower(form_employer), 'tata consultancy')) OR (contains(lower(form_employer), 'tcs') AND contains(lower(slip_employer), 'tata consultancy')) OR (contains(lower(slip_employer), 'infosys') AND contains(lower(form_employer), 'infy'))"
_KNOWN = "SELECT * FROM document_checks WHERE coalesce(slip_employer, '') <> '' AND coalesce(form_employer, '') <> ''"
_EMPLOYERS = f"""SELECT application_id, slip_employer, form_employer, similarity, CASE WHEN similarity >= 0.75::DOUBLE THEN 'MATCH' ELSE 'MISMATCH' END AS status
 FROM (SELECT * REPLACE (CASE WHEN {_SHORT} THEN 0.98::DOUBLE ELSE similarity END AS similarity) FROM ({name_similarity(_KNOWN, "slip_employer", "form_employer")}))"""
_INCOMES = f"""SELECT application_id, coalesce(nullif(month_year, ''), 'Latest Month') AS month_year, net_salary, credited, variance, variance_pct,
 CASE WHEN variance_pct <= 5 THEN 'MATCH' WHEN variance_pct <= 15 THEN 'WITHIN_TOLERANCE' ELSE 'DISCREPANCY' END AS status FROM (
 SELECT *, {r("variance / greatest(net_salary, 1) * 100", 2)} AS variance_pct FROM (SELECT *, {r("abs(net_salary - credited)", 2)} AS variance FROM (
 SELECT application_id, month_year, net_salary, coalesce((list_sort([{{'apart': abs(credits[i] - net_salary), 'i': i, 'a': credits[i]}} for i in range(1, len(credits) + 1)])[1]).a, 0) AS credited
 FROM (SELECT application_id, month_year, coalesce(net_salary, 0) AS net_salary FROM slips) JOIN (SELECT DISTINCT application_id FROM doc_texts WHERE true_type = 'BANK_STATEMENT') USING (application_id)
 LEFT JOIN (SELECT application_id, list(amount ORDER BY line) AS credits FROM tagged WHERE category = 'SALARY' GROUP BY 1) USING (application_id))))"""
_MONEY = "'₹' || format('{{:,.2f}}', {})".format
_DISPUTED = f"""SELECT application_id, list(text ORDER BY kind, a, b) AS contradictions, count(*) FILTER (WHERE kind > 1) AS n_other FROM (
 SELECT application_id, 1 AS kind, {_RANK.replace("document)", "document_1)")} AS a, {_RANK.replace("document)", "document_2)")} AS b,
 concat('Name mismatch between ', document_1, ' and ', document_2, ': ''', name_1, ''' vs ''', name_2, ''' (Similarity: ', printf('%.0f', similarity * 100), '%)') AS text FROM pairs WHERE status = 'MISMATCH'
 UNION ALL SELECT application_id, 2, 0, 0, concat('Employer mismatch: Payslip employer ''', slip_employer, ''' does not match Form 16 employer ''', form_employer, '''.') FROM employers WHERE status = 'MISMATCH'
 UNION ALL SELECT application_id, 3, 0, 0, concat('Income discrepancy in ', month_year, ': Bank credit (', {_MONEY("credited")}, ') differs significantly from Payslip Net (', {_MONEY("net_salary")}, ').') FROM incomes WHERE status = 'DISCREPANCY') GROUP BY 1"""
_DATED = f"SELECT *, {_MONTH} AS m, coalesce(month_year, 'None') AS said FROM slips"
_FAULTS = f"""SELECT application_id, concat('Payslip #1 (', said, ')') AS slip, gross_salary > 0 AND NOT (net_salary > 0 AND abs(gross_salary - total_deductions - net_salary) <= 2) AS bad,
 CASE WHEN coalesce(month_year, '') = '' THEN 'Payslip month/year was not found on the document.' WHEN m IS NULL THEN concat('Could not parse payslip date: ''', month_year, '''.')
  WHEN old < 0 THEN concat('Payslip for ', month_year, ' is dated in the future relative to today ({AS_OF}).')
  WHEN old > 3 THEN concat('Payslip for ', month_year, ' is ', old, ' months old, outside the required last-3-months window.') END AS late
 FROM (SELECT *, (2024 - year(m)) * 12 + 6 - month(m) AS old FROM ({_DATED}))"""
_RECONCILED = f"""SELECT application_id, n AS n_contradictions, {r('CASE WHEN n > 0 THEN greatest(0.2::DOUBLE, m - least(0.5::DOUBLE, 0.15::DOUBLE * n)) ELSE m END', 3)} AS reconciliation_score FROM (
 SELECT c.application_id, coalesce(avg(similarity), 1) AS m, count(*) FILTER (WHERE status = 'MISMATCH') + coalesce(max(o.n_other), 0) AS n
 FROM document_checks c LEFT JOIN pairs p ON p.application_id = c.application_id LEFT JOIN disputed o ON o.application_id = c.application_id GROUP BY 1)"""
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN NOT ({h}) THEN '{n}' END" for h, n in zip(("has_pan", "has_aadhaar", "has_slips OR has_form_16 OR has_itr", "has_statement", "has_property"), reconcile.REQUIREMENTS, strict=True)) + "], lambda x: x IS NOT NULL)"
_TRUSTED = f"""SELECT *, CASE WHEN overall_confidence >= 0.8::DOUBLE THEN 'HIGH' WHEN overall_confidence >= 0.7::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM (
 SELECT *, {r("greatest(0, least(1, 0.15::DOUBLE * ocr_quality + 0.3::DOUBLE * fv + 0.35::DOUBLE * reconciliation_score + 0.2::DOUBLE * completeness))", 3)} AS overall_confidence FROM (
 SELECT c.*, reconciliation_score, n_contradictions, {_MISSING} AS missing, coalesce(classification_confidence, 0.5) AS ocr_quality, coalesce(n_passed / nullif(n_checks, 0)::DOUBLE, 0.5) AS fv, (5 - len({_MISSING})) / 5.0::DOUBLE AS completeness FROM document_checks c JOIN reconciled USING (application_id)))"""
#: Lists of texts, empty where their condition fails.
_REASONS = f"""(CASE WHEN len(missing) > 0 THEN [concat('Missing mandatory documents: ', array_to_string(missing, ', '))] ELSE [] END || [concat('Contradiction flagged: ', x) for x in coalesce(contradictions, [])]
 || CASE WHEN bad THEN [concat(slip, ' arithmetic inconsistency between Gross, Deductions, and Net pay.')] ELSE [] END || CASE WHEN late IS NOT NULL THEN [concat(slip, ': ', late)] ELSE [] END
 || CASE WHEN n_bounces > 0 THEN [concat('Detected ', n_bounces, ' inward ECS/cheque bounce(s) in bank statement.')] ELSE [] END
 || CASE WHEN overall_confidence < 0.8::DOUBLE THEN [printf('Overall extraction confidence (%.1f%%) is below 80%% threshold.', {r("overall_confidence * 100", 1)})] ELSE [] END)"""
_ACTIONS = """concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'Request missing mandatory documents from loan applicant.' END,
 CASE WHEN len(contradictions) > 0 THEN 'Manual underwriter review required to verify name / income discrepancies.' END, CASE WHEN bad THEN 'Cross-check original physical/PDF payslip line items.' END,
 CASE WHEN late IS NOT NULL THEN 'Request a current payslip within the required recency window.' END, CASE WHEN n_bounces > 0 THEN 'Escalate banking behavior to Credit Risk Analyst.' END,
 CASE WHEN overall_confidence < 0.8::DOUBLE THEN 'Conduct comprehensive Human-in-the-Loop document inspection.' END)"""
_ROUTED = f"""SELECT *, len(reasons) > 0 AS requires_human_review, CASE WHEN len(missing) > 0 OR coalesce(len(contradictions), 0) > 0 THEN 'HIGH' WHEN len(reasons) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS priority
 FROM (SELECT *, {_REASONS} AS reasons, {_ACTIONS} AS actions FROM trusted LEFT JOIN (SELECT application_id, contradictions FROM disputed) USING (application_id) LEFT JOIN faults USING (application_id))"""
_GATES = """SELECT gate, count(*) AS n FROM (SELECT CASE WHEN contains(x, 'Missing mandatory') THEN 'missing_mandatory_docs' WHEN contains(x, 'Name mismatch') THEN 'name_contradiction'
 WHEN contains(x, 'Income discrepancy') THEN 'income_discrepancy' WHEN contains(x, 'arithmetic inconsistency') THEN 'salary_arithmetic_failure'
 WHEN contains(lower(x), 'below') AND contains(lower(x), 'threshold') THEN 'low_confidence_gate' WHEN contains(x, 'bounce') THEN 'banking_bounce_warning' END AS gate
 FROM (SELECT unnest(reasons) AS x FROM routed)) WHERE gate IS NOT NULL GROUP BY 1"""


def _d(sql):
    read = {k: CHAIN[k] for k in ("slips", "lines", "tagged")}
    return oracle(
        sql, "named_documents", "document_checks", "doc_texts", **read, named=_NAMED, pairs=_PAIRS, employers=_EMPLOYERS, incomes=_INCOMES, disputed=_DISPUTED, faults=_FAULTS,
        reconciled=_RECONCILED, trusted=_TRUSTED, routed=_ROUTED,
    )


def _share(x):
    return r(f"avg(CAST({x} AS INT))", 4)


_TP, _ACTUAL = "count(*) FILTER (WHERE has_contradiction AND n_other > 0)", "count(*) FILTER (WHERE has_contradiction)"
_FIRST = "SELECT * REPLACE (CAST(floor(listing_id / 3) AS BIGINT) AS listing_id) FROM (SELECT *, row_number() OVER (PARTITION BY floor(listing_id / 3) ORDER BY listing_id) AS k FROM clean WHERE source = '{}') WHERE k = 1".format
_EMPTY = "coalesce(trim(CAST({0} AS VARCHAR)), '') IN ('', '0', '0.0')".format


def _filled(n):
    return f"CASE WHEN {_EMPTY(f'a.{n}')} AND NOT {_EMPTY(f'b.{n}')} THEN b.{n} ELSE a.{n} END"


_TAKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN a.listing_id IS NOT NULL AND {_EMPTY(f'a.{n}')} AND NOT {_EMPTY(f'b.{n}')} THEN '{n}' END" for n in matching.MERGEABLE) + ")"
#: Each pair in its order, with the lists of ends that are taken so far.
_WALK = """ordered AS (SELECT a, b, row_number() OVER (ORDER BY score DESC, a DESC, b DESC) AS k FROM candidates),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS la, []::BIGINT[] AS lb UNION ALL SELECT o.k, CASE WHEN list_contains(la, a) OR list_contains(lb, b) THEN la ELSE list_append(la, a) END, CASE WHEN list_contains(la, a) OR list_contains(lb, b) THEN lb ELSE list_append(lb, b) END FROM walk w JOIN ordered o ON o.k = w.k + 1),
chosen AS (SELECT unnest(la) AS a, unnest(lb) AS b FROM (SELECT la, lb FROM walk ORDER BY k DESC LIMIT 1))"""
ORACLE = {
    "j07_candidates": _l("SELECT * FROM candidates"),
    "w07_mutual_best": _l("SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS ka, row_number() OVER (PARTITION BY b ORDER BY score DESC, a DESC) AS kb FROM candidates) WHERE ka = 1 AND kb = 1"),
    "j08_assigned": _l("SELECT a, b, score FROM chosen JOIN candidates USING (a, b)").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT a, b, score FROM chosen", f", {_WALK} SELECT a, b, score FROM chosen"),
    "j10_merged_pair": _l(f"SELECT coalesce(a.listing_id, b.listing_id) AS listing_id, {_filled('bathrooms')} AS bathrooms, {_filled('furnishing')} AS furnishing, {_filled('parking')} AS parking, concat_ws(',', CASE WHEN b.listing_id IS NOT NULL THEN 'housing' END, CASE WHEN a.listing_id IS NOT NULL THEN 'magicbricks' END) AS sources, CAST(a.listing_id IS NOT NULL AS INT) + CAST(b.listing_id IS NOT NULL AS INT) AS source_count, {_TAKEN} AS imputed_fields FROM ({_FIRST('magicbricks')}) a FULL JOIN ({_FIRST('housing')}) b ON a.listing_id = b.listing_id"),
    "t04_largest_source": _l("SELECT source, count(*) AS n FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "j03_name_pairs": _d("SELECT * FROM pairs"),
    "j03_contradictions": _d("SELECT application_id, unnest(range(len(contradictions))) AS place, unnest(contradictions) AS contradiction FROM disputed"),
    "j04_incomes": _d("SELECT * FROM incomes"),
    "j05_employers": _d("SELECT * FROM employers"),
    "j06_addresses": _d("SELECT application_id, kyc_pincode = property_pincode AS pincode_match, CASE WHEN coalesce(kyc_address, '') <> '' AND coalesce(property_city, '') <> '' THEN contains(lower(kyc_address), lower(property_city)) ELSE true END AS city_match FROM document_checks WHERE coalesce(kyc_pincode, '') <> '' AND coalesce(property_pincode, '') <> ''"),
    "a54_reconciliation": _d("SELECT * FROM reconciled"),
    "v08_missing_documents": _d(f"SELECT application_id, array_to_string({_MISSING}, '; ') AS missing FROM document_checks"),
    "a55_ingestion_confidence": _d("SELECT application_id, ocr_quality, round(fv, 3) AS field_validation, reconciliation_score, completeness, overall_confidence, confidence_level FROM trusted"),
    "a56_review_routing": _d("SELECT application_id, requires_human_review, priority, array_to_string(reasons, '; ') AS reasons, actions FROM routed"),
    "a10_operational": _d(f"SELECT count(*) AS total_applications, {_share('NOT requires_human_review')} AS stp_rate, {_share('requires_human_review')} AS hitl_rate, {r('avg(overall_confidence)', 4)} AS mean_confidence, {_share('overall_confidence < 0.8::DOUBLE')} AS below_threshold_rate FROM routed"),
    "a10_gate_triggers": _d(_GATES),
    "a38_reconciliation_quality": _d(f"SELECT *, {r('2 * precision * recall / greatest(precision + recall, 1e-6::DOUBLE)', 4)} AS f1 FROM (SELECT {r(f'{_TP} / greatest({_ACTUAL}, 1)::DOUBLE', 4)} AS recall, {r(f'{_TP} / greatest(count(*) FILTER (WHERE n_other > 0), 1)::DOUBLE', 4)} AS precision, {r(f'count(*) FILTER (WHERE has_contradiction AND n_other > 0 AND coalesce(action_matched, true)) / greatest({_TP}, 1)::DOUBLE', 4)} AS handling_accuracy, {r('count(*) FILTER (WHERE name_correct) / greatest(count(name_correct), 1)::DOUBLE', 4)} AS name_accuracy, {r('count(*) FILTER (WHERE salary_correct) / greatest(count(salary_correct), 1)::DOUBLE', 4)} AS salary_accuracy, {_ACTUAL} AS actual, {_TP} AS detected FROM document_checks)"),
}

_JUDGED = "SELECT *, requires_human_review = (has_contradiction OR len(missing) > 0) AS ok FROM routed"
_GATE_SUMS = ", ".join(f"coalesce(sum(n) FILTER (WHERE gate = '{g}'), 0) AS {g}" for g in reconcile.GATES)
#: Section -> its one-row query and columns.
_REPORT = {
    "classification": (document_plans.ORACLE["a32_class_summary"], ("n", "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")),
    "cost": (document_plans.ORACLE["a33_class_cost"], ("n", "cost_weighted_error")),
    "brier": (_d(f"SELECT count(*) AS n, {r('avg(pow(overall_confidence - CAST(ok AS INT), 2))', 6)} AS brier FROM ({_JUDGED})"), ("n", "brier")),
    "calibration": (
        _d(f"""SELECT {r('sum(n * abs(c - a)) / sum(n)', 6)} AS ece FROM (
 SELECT least(floor(overall_confidence * 10), 9) AS bin, count(*) AS n, avg(overall_confidence) AS c, avg(CAST(ok AS INT)) AS a FROM ({_JUDGED}) GROUP BY 1)"""), ("ece",),
    ),
    "gate": (_d(f"SELECT count(*) AS passing, coalesce({r('avg(1 - CAST(ok AS INT))', 6)}, 0) AS gate_error FROM ({_JUDGED}) WHERE overall_confidence >= 0.8::DOUBLE"), ("passing", "gate_error")),
    "reconciliation": (ORACLE["a38_reconciliation_quality"], ("recall", "precision", "handling_accuracy", "name_accuracy", "salary_accuracy", "actual", "detected", "f1")),
    "operational": (ORACLE["a10_operational"], ("total_applications", "stp_rate", "hitl_rate", "mean_confidence", "below_threshold_rate")),
    "gates": (_d(f"SELECT {_GATE_SUMS} FROM ({_GATES})"), reconcile.GATES),
}
ORACLE["a46_ingestion_report"] = " UNION ALL ".join(
    f"SELECT '{section}' AS section, x.metric AS metric, x.value AS value FROM (SELECT unnest([" + ", ".join(f"{{'metric': '{n}', 'value': CAST({n} AS DOUBLE)}}" for n in names) + f"]) AS x FROM ({sql}))"
    for section, (sql, names) in _REPORT.items()
)
