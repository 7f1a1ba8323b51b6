"""Documents of one application against each other, the trust in them, and what people have to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.columns import present, rounded
from loanloom.operators import validators
from loanloom.operators.texts import name_similarity

#: The documents that name a person, in the order they are compared; what an application needs;
#: the least confidence that passes.
NAMED = ("PAN Card", "Aadhaar Card", "Salary Slip", "Form 16", "Bank Statement", "Property Deed")
REQUIREMENTS = ("PAN Card (Mandatory KYC)", "Aadhaar Card (Mandatory KYC & Address Proof)", "Income Proof (Salary Slips / Form 16 / ITR)", "Bank Account Statement (6 Months Mandatory)", "Property Documents (Sale Deed / Allotment Letter)")
PASSES = 0.80
GATES = ("missing_mandatory_docs", "name_contradiction", "income_discrepancy", "salary_arithmetic_failure", "low_confidence_gate", "banking_bounce_warning")


def name_pairs(names: DataFrame, by: str | None = None) -> DataFrame:
    """Of rows (application_id, document, name): each pair of an application's documents (at most six, the first
    of each kind by the column named, else by name) with its similarity, status and notes."""
    order = F.array_position(F.array(*map(F.lit, NAMED)), F.col("document"))
    known = names.where((order > 0) & (F.coalesce("name", F.lit("")) != ""))
    one = known.groupBy("application_id", order.cast("int").alias("place")).agg((F.min_by("name", by) if by else F.min("name")).alias("name"))
    lists = one.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("x"))  # six at most
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["place"] > a["place"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = lists.select("application_id", F.explode(pairs).alias("p"))
    kind = lambda p: F.element_at(F.array(*map(F.lit, NAMED)), p)
    score = name_similarity(F.col("p.a.name"), F.col("p.b.name"))
    found = rows.select("application_id", kind(F.col("p.a.place")).alias("document_1"), F.col("p.a.name").alias("name_1"), kind(F.col("p.b.place")).alias("document_2"), F.col("p.b.name").alias("name_2"), score.alias("similarity"))
    c = F.col
    found = found.withColumn("status", F.when(c("similarity") >= 0.95, "EXACT_MATCH").when(c("similarity") >= 0.80, "FUZZY_MATCH").otherwise("MISMATCH"))
    both = (c("document_1"), F.lit(" ('"), c("name_1"), F.lit("') and "), c("document_2"), F.lit(" ('"), c("name_2"), F.lit("')."))
    off = F.concat(F.lit("Significant name mismatch: '"), c("name_1"), F.lit("' ("), c("document_1"), F.lit(") vs '"), c("name_2"), F.lit("' ("), c("document_2"), F.lit(")."))
    notes = F.when(c("status") == "EXACT_MATCH", F.concat(F.lit("Names match closely between "), *both))
    return found.withColumn("notes", notes.when(c("status") == "FUZZY_MATCH", F.concat(F.lit("Minor spelling or name format difference between "), *both)).otherwise(off))


def employers(df: DataFrame, slip: str, form: str) -> DataFrame:
    """The slip's employer against the form's; known short forms count as equal. Rows that lack one are left out."""
    a, b = F.lower(F.col(slip)), F.lower(F.col(form))
    has = lambda x, part: F.contains(x, F.lit(part))
    short = (has(a, "tcs") & has(b, "tata consultancy")) | (has(b, "tcs") & has(a, "tata consultancy")) | (has(a, "infosys") & has(b, "infy"))
    score = F.when(short, 0.98).otherwise(name_similarity(F.col(slip), F.col(form)))
    there = (F.coalesce(slip, F.lit("")) != "") & (F.coalesce(form, F.lit("")) != "")
    found = df.where(there).select("application_id", F.col(slip).alias("slip_employer"), F.col(form).alias("form_employer"), score.alias("similarity"))
    return found.withColumn("status", F.when(F.col("similarity") >= 0.75, "MATCH").otherwise("MISMATCH"))


def incomes(slips: DataFrame, statements: DataFrame) -> DataFrame:
    """Each payslip of an application with a bank statement against the salary credit nearest to its net pay (the
    earliest of equally near ones, 0 without any). slips: application_id, place, month_year, net_salary; statements:
    one row an application with credits, its salary credits in order (null: none)."""
    c = F.col
    net = F.coalesce("net_salary", F.lit(0.0))
    apart = F.transform("credits", lambda x, i: F.struct(F.abs(x - net).alias("apart"), i.alias("i"), x.alias("amount")))
    rows = slips.join(statements, "application_id").select("application_id", "place", F.coalesce(F.when(c("month_year") != "", c("month_year")), F.lit("Latest Month")).alias("month_year"), net.alias("net_salary"), F.coalesce(F.array_min(apart)["amount"], F.lit(0.0)).alias("credited"))
    rows = rows.withColumn("variance", rounded(F.abs(c("net_salary") - c("credited")), 2))
    rows = rows.withColumn("variance_pct", rounded(c("variance") / F.greatest("net_salary", F.lit(1.0)) * 100.0, 2))
    return rows.withColumn("status", F.when(c("variance_pct") <= 5, "MATCH").when(c("variance_pct") <= 15, "WITHIN_TOLERANCE").otherwise("DISCREPANCY"))


def salary_credits(statements: DataFrame, found: DataFrame) -> DataFrame:
    """application_id of statements with credits: the amounts of its salary rows in documents.transactions(), in order."""
    rows = found.where("category = 'SALARY'").groupBy("application_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "amount"))), lambda x: x["amount"]).alias("credits"))
    return statements.select("application_id").distinct().join(rows, "application_id", "left")


def compared(pairs: DataFrame, found_employers: DataFrame, found_incomes: DataFrame) -> DataFrame:
    """One row an application with anything to compare: the texts of its contradictions (names by pair, then the
    employer, then payslips in order), n_names and n_other, how many of them are about names and how many aren't, and the
    mean similarity of its name pairs. Each input is read once: rows that agree have no text, they aren't filtered."""
    c = F.col
    place = lambda name: F.array_position(F.array(*map(F.lit, NAMED)), c(name)).cast("int")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    money = lambda name: said("₹", F.format_number(name, 2))
    percent = F.bround(c("similarity") * 100).cast("int").cast("string")
    # fixed values: the texts, as people read them
    names = said("Name mismatch between ", c("document_1"), " and ", c("document_2"), ": '", c("name_1"), "' vs '", c("name_2"), "' (Similarity: ", percent, "%)")
    employer = said("Employer mismatch: Payslip employer '", c("slip_employer"), "' does not match Form 16 employer '", c("form_employer"), "'.")
    income = said("Income discrepancy in ", c("month_year"), ": Bank credit (", money("credited"), ") differs significantly from Payslip Net (", money("net_salary"), ").")
    row = lambda df, kind, at, bad, text, score: df.select("application_id", F.lit(kind).alias("kind"), at.cast("long").alias("at"), F.when(c("status") == bad, text).alias("text"), score.cast("double").alias("score"))
    rows = row(pairs, 1, place("document_1") * 10 + place("document_2"), "MISMATCH", names, c("similarity"))
    rows = rows.unionByName(row(found_employers, 2, F.lit(0), "MISMATCH", employer, F.lit(None)))
    rows = rows.unionByName(row(found_incomes, 3, c("place"), "DISCREPANCY", income, F.lit(None)))
    texts = F.transform(F.array_sort(F.collect_list(F.when(c("text").isNotNull(), F.struct("kind", "at", "text")))), lambda x: x["text"])
    many = lambda which: F.count_if(which & c("text").isNotNull())
    return rows.groupBy("application_id").agg(texts.alias("contradictions"), many(c("kind") == 1).alias("n_names"), many(c("kind") > 1).alias("n_other"), F.avg("score").alias("mean"))


def contradictions(pairs: DataFrame, found_employers: DataFrame, found_incomes: DataFrame) -> DataFrame:
    """The applications of compared() that have contradictions: their texts and n_other."""
    return compared(pairs, found_employers, found_incomes).where(F.size("contradictions") > 0).select("application_id", "contradictions", "n_other")


def slip_faults(slips: DataFrame, as_of: str, window: int = 3) -> DataFrame:
    """One row an application with payslips: a text for each that doesn't add up (bad_slips) and for each outside
    the window (old_slips), both in their order. slips: application_id, place, month_year, gross_salary, net_salary, total_deductions."""
    c = F.col
    # number: a slip's place among its application's
    rows = slips.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("place", "month_year", "gross_salary", "net_salary", "total_deductions"))).alias("all"))
    rows = rows.select("application_id", F.posexplode("all").alias("i", "s")).select("application_id", (c("i") + 1).alias("number"), "s.*")
    sums = validators.salary_result(c("gross_salary"), c("net_salary"), c("total_deductions"), F.lit(0.0))
    dated = validators.recency_result(c("month_year"), as_of, window)
    named = F.concat(F.lit("Payslip #"), c("number"), F.lit(" ("), F.coalesce("month_year", F.lit("None")), F.lit(")"))
    bad = F.when(~sums["is_valid"] & (c("gross_salary") > 0), F.concat(named, F.lit(" arithmetic inconsistency between Gross, Deductions, and Net pay.")))
    old = F.when(~dated["is_valid"], F.concat(named, F.lit(": "), dated["message"]))
    rows = rows.select("application_id", "number", bad.alias("bad"), old.alias("old"))
    inorder = lambda x: F.transform(F.array_sort(F.collect_list(F.when(c(x).isNotNull(), F.struct("number", x)))), lambda y: y[x])
    return rows.groupBy("application_id").agg(inorder("bad").alias("bad_slips"), inorder("old").alias("old_slips"))


def addresses(df: DataFrame) -> DataFrame:
    """The address of identity papers against the property's: equal postal codes, and whether the address names
    the property's city (also where one of the two is missing). Rows without both postal codes are left out."""
    city = F.when((F.coalesce("kyc_address", F.lit("")) != "") & (F.coalesce("property_city", F.lit("")) != ""), F.contains(F.lower("kyc_address"), F.lower("property_city"))).otherwise(True)
    there = (F.coalesce("kyc_pincode", F.lit("")) != "") & (F.coalesce("property_pincode", F.lit("")) != "")
    return df.where(there).select("application_id", (F.col("kyc_pincode") == F.col("property_pincode")).alias("pincode_match"), city.alias("city_match"))


def reconciliation(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """application_id, contradictions and score: the mean similarity of its name pairs (1 without any) less 0.15 for
    each contradiction, 0.5 at most, not below 0.2. others: application_id and n_other contradictions of all
    applications."""
    names = pairs.groupBy("application_id").agg(F.avg("similarity").alias("mean"), F.count_if(F.col("status") == "MISMATCH").alias("n_names"))
    return reconciled(others.join(names, "application_id", "left")).select("application_id", "n_contradictions", "reconciliation_score")


def reconciled(df: DataFrame) -> DataFrame:
    """df with n_contradictions and reconciliation_score from mean, n_names and n_other (null: nothing to compare)."""
    c = F.col
    df = df.withColumns({"n_contradictions": F.coalesce("n_names", F.lit(0)) + F.coalesce("n_other", F.lit(0)), "mean": F.coalesce("mean", F.lit(1.0))})
    less = F.when(c("n_contradictions") > 0, F.greatest(F.lit(0.2), c("mean") - F.least(F.lit(0.5), 0.15 * c("n_contradictions")))).otherwise(c("mean"))
    return df.withColumn("reconciliation_score", rounded(less, 3))


def missing_documents(c) -> Column:
    """The requirements that an application's documents don't meet, in order; any of slips, form 16 and return is
    proof of income."""
    no = lambda x: ~F.coalesce(x, F.lit(False))
    held = (c("has_pan"), c("has_aadhaar"), c("has_slips") | c("has_form_16") | c("has_itr"), c("has_statement"), c("has_property"))
    return present(*[(no(h), name) for h, name in zip(held, REQUIREMENTS, strict=True)])


def ingestion_confidence(df: DataFrame) -> DataFrame:
    """df with missing_documents, the four parts of the confidence, the whole and its level. It needs has_ columns,
    classification_confidence (mean, null: 0.5), n_checks, n_passed and reconciliation_score."""
    c = F.col
    df = df.withColumn("missing_documents", missing_documents(c))
    df = df.withColumns({
        "ocr_quality": F.coalesce("classification_confidence", F.lit(0.5)), "field_validation": F.coalesce(F.try_divide("n_passed", "n_checks"), F.lit(0.5)),
        "completeness": (5 - F.size("missing_documents")) / 5.0,
    })
    whole = 0.15 * c("ocr_quality") + 0.30 * c("field_validation") + 0.35 * c("reconciliation_score") + 0.20 * c("completeness")
    df = df.withColumn("overall_confidence", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 3))
    return df.withColumn("confidence_level", F.when(c("overall_confidence") >= PASSES, "HIGH").when(c("overall_confidence") >= 0.7, "MEDIUM").otherwise("LOW"))


def review_routing(df: DataFrame, *keep: Column) -> DataFrame:
    """application_id (and what else is to be kept) with whether people have to look, the priority, and reasons and actions in order: one reason
    for each contradiction and each faulty payslip. It needs the columns of ingestion_confidence() and contradictions,
    bad_slips and old_slips (arrays of texts, null: none) and n_bounces."""
    c = F.col
    many = lambda name: F.coalesce(c(name), F.array().cast("array<string>"))
    only = lambda condition, text: F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))
    lacks, low, bounced = F.size("missing_documents") > 0, c("overall_confidence") < PASSES, F.coalesce("n_bounces", F.lit(0)) > 0
    percent = F.format_string("%.1f", rounded(c("overall_confidence") * 100, 1))
    # fixed values: the texts, as people read them
    check, current = "Cross-check original physical/PDF payslip line items.", "Request a current payslip within the required recency window."
    reasons = F.concat(
        only(lacks, F.concat(F.lit("Missing mandatory documents: "), F.array_join("missing_documents", ", "))),
        F.transform(many("contradictions"), lambda x: F.concat(F.lit("Contradiction flagged: "), x)), many("bad_slips"), many("old_slips"),
        only(bounced, F.concat(F.lit("Detected "), c("n_bounces").cast("string"), F.lit(" inward ECS/cheque bounce(s) in bank statement."))),
        only(low, F.concat(F.lit("Overall extraction confidence ("), percent, F.lit(f"%) is below {PASSES:.0%} threshold."))),
    )
    disputed = F.size(many("contradictions")) > 0
    actions = F.concat(
        only(lacks, F.lit("Request missing mandatory documents from loan applicant.")),
        only(disputed, F.lit("Manual underwriter review required to verify name / income discrepancies.")),
        F.transform(many("bad_slips"), lambda x: F.lit(check)), F.transform(many("old_slips"), lambda x: F.lit(current)),
        only(bounced, F.lit("Escalate banking behavior to Credit Risk Analyst.")),
        only(low, F.lit("Conduct comprehensive Human-in-the-Loop document inspection.")),
    )
    priority = F.when(lacks | disputed, "HIGH").when(F.size(reasons) > 0, "MEDIUM").otherwise("NONE")
    df = df.select("application_id", *keep, "overall_confidence", reasons.alias("reasons"), actions.alias("actions"), priority.alias("priority"))
    return df.withColumn("requires_human_review", F.size("reasons") > 0)


def gate_of(reason: Column) -> Column:
    """The category of a reason text, by the first substring that fits; null for others."""
    has = lambda part: F.contains(reason, F.lit(part))
    low = F.lower(reason)
    return (
        F.when(has("Missing mandatory"), "missing_mandatory_docs").when(has("Name mismatch"), "name_contradiction").when(has("Income discrepancy"), "income_discrepancy").when(has("arithmetic inconsistency"), "salary_arithmetic_failure")
        .when((F.contains(low, F.lit("below")) & F.contains(low, F.lit("threshold"))) | has("below 85%"), "low_confidence_gate").when(has("bounce"), "banking_bounce_warning")
    )


def operational(routed: DataFrame, threshold: float = PASSES) -> DataFrame:
    """One row: applications, shares passing straight and sent to people, mean confidence, share below threshold."""
    share = lambda x: rounded(F.avg(x.cast("int")), 4)
    people = F.col("requires_human_review")
    return routed.agg(F.count("*").alias("total_applications"), share(~people).alias("stp_rate"), share(people).alias("hitl_rate"), rounded(F.avg("overall_confidence"), 4).alias("mean_confidence"), share(F.col("overall_confidence") < threshold).alias("below_threshold_rate"))


def gate_triggers(routed: DataFrame) -> DataFrame:
    """How often each category of reason sent an application to people."""
    rows = routed.select(F.explode("reasons").alias("reason")).select(gate_of(F.col("reason")).alias("gate"))
    return rows.where("gate is not null").groupBy("gate").agg(F.count("*").alias("n"))


def quality(cases: DataFrame) -> DataFrame:
    """How well contradictions are found: recall, precision, F1, how often those found led to the right action, and
    the accuracy of name and salary checks over the cases that have them. Zero of nothing."""
    c = F.col
    actual, said = F.coalesce(c("has_contradiction"), F.lit(False)), F.coalesce(c("predicted_contradiction"), F.lit(False))
    tp, fp, fn = F.count_if(actual & said), F.count_if(~actual & said), F.count_if(actual & ~said)
    four = lambda a, b: rounded(a / F.greatest(b, F.lit(1)), 4)
    acted = F.count_if(actual & said & F.coalesce(c("action_matched"), F.lit(True)))
    df = cases.agg(four(tp, tp + fn).alias("recall"), four(tp, tp + fp).alias("precision"), four(acted, tp).alias("handling_accuracy"), four(F.count_if(c("name_correct")), F.count("name_correct")).alias("name_accuracy"), four(F.count_if(c("salary_correct")), F.count("salary_correct")).alias("salary_accuracy"), (tp + fn).alias("actual"), tp.alias("detected"))
    return df.withColumn("f1", rounded(2 * c("precision") * c("recall") / F.greatest(c("precision") + c("recall"), F.lit(1e-6)), 4))
