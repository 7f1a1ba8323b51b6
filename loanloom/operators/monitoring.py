"""Portfolio and model monitoring. Every metric is one aggregation; windows run on small aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.config import BUREAU_SOURCES, CREDIT, FLAGS, UNVERIFIED
from loanloom.functions.columns import clamp, lookup, rounded
from loanloom.functions.lineage import cut


def dimension(df: DataFrame, name: str, values: tuple) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def percent(n: Column, total: Column) -> Column:
    """100 * n / total with two places; 0 of nothing."""
    return F.coalesce(rounded(F.try_divide(100.0 * n, total), 2), F.lit(0.0))


def counted(df: DataFrame, name: str, conditions: dict[str, Column], total: Column) -> DataFrame:
    """name, n and pct of each condition, zero rows too: one aggregation, no join. Rows whose pct has no meaning
    are left to the caller."""
    one = df.agg(F.count_if(total).alias("total"), *[F.count_if(F.coalesce(holds, F.lit(False))).alias(f"n{k}") for k, holds in enumerate(conditions.values())])
    rows = F.array(*[F.struct(F.lit(x).alias(name), F.col(f"n{k}").alias("n"), percent(F.col(f"n{k}"), F.col("total")).alias("pct")) for k, x in enumerate(conditions)])
    return one.select(F.inline(rows))


def source_mix(records: DataFrame) -> DataFrame:
    """Applications by source of the bureau data; what is no known source is unknown."""
    source = F.col("bureau_source")
    known = {x: source == x for x in BUREAU_SOURCES}
    return counted(records, "source", known | {"unknown": ~F.coalesce(source.isin(*BUREAU_SOURCES), F.lit(False))}, F.lit(True))


def source_summary(records: DataFrame) -> DataFrame:
    """The shares of simulated and of unverified data, and whether none is simulated (of a non-empty table)."""
    n, simulated = F.count("*"), F.count_if(F.col("bureau_source") == "simulated")
    return records.agg(n.alias("total"), percent(simulated, n).alias("simulated_share_pct"), percent(F.count_if(F.col("bureau_source").isin(*UNVERIFIED)), n).alias("unverified_share_pct"), ((n > 0) & (simulated == 0)).alias("meets_production_target"))


def flag_rates(records: DataFrame) -> DataFrame:
    """Applications with each category of flag, with any other one and with any at all, and their share of all."""
    other = F.exists("flags", lambda x: ~x.isin(*FLAGS))
    return counted(records, "flag", {x: F.array_contains("flags", x) for x in FLAGS} | {"other": other, "any": F.size("flags") > 0}, F.lit(True))


def decision_distribution(records: DataFrame, column: str = "preliminary_decision", known: tuple[str, ...] = ("APPROVE", "CONDITIONAL", "REJECT")) -> DataFrame:
    """Decisions and their share of the decided; those that are none of the known ones are other, blank ones
    missing, which has no share."""
    value = F.nullif(F.upper(F.trim(F.col(column))), F.lit(""))
    found = counted(records, "decision", {x: value == x for x in known} | {"other": ~value.isin(*known), "missing": value.isNull()}, value.isNotNull())
    return found.withColumn("pct", F.when(F.col("decision") != "missing", F.col("pct")))


def confidence_bins(records: DataFrame) -> DataFrame:
    """20 bins of 0.05 with their share of the assessed, empty ones too."""
    c, known = F.col("credit_confidence"), F.col("credit_confidence").isNotNull() & F.col("preliminary_decision").isNotNull()
    number = F.greatest(F.lit(0), F.least(F.lit(19), F.floor(c / 0.05 + 1e-9)))
    return counted(records, "bin", {f"{k * 0.05:.2f}-{(k + 1) * 0.05:.2f}": known & (number == k) for k in range(20)}, known)


def confidence_summary(records: DataFrame, alert: float = 20.0, tolerance: float = 0.005) -> DataFrame:
    """Assessed applications, how many have the least confidence, whether that is an alert, and how many have
    another confidence than score and flags give."""
    rule = CREDIT["confidence"]
    expected = rule["base"] - F.when(F.col("cibil_score").isNull(), rule["no_history"]).otherwise(0.0) - F.col("n_flags") * rule["per_flag"]
    expected = rounded(clamp(expected, rule["floor"], 1.0), 2)
    known = F.col("credit_confidence").isNotNull() & F.col("preliminary_decision").isNotNull()
    n, low = F.count("*"), F.count_if(F.col("credit_confidence") <= rule["floor"] + 1e-9)
    return records.where(known).agg(n.alias("n"), low.alias("at_floor"), percent(low, n).alias("at_floor_pct"), (percent(low, n) > alert).alias("floor_alert"), F.count_if(F.abs(expected - F.col("credit_confidence")) > tolerance).alias("formula_mismatches"))


#: What a credit decision is expected to end in, and the pairs that contradict each other most.
EXPECTED = {"APPROVE": "APPROVE", "CONDITIONAL": "SUSPEND", "REJECT": "DENY"}
SEVERE = (("APPROVE", "DENY"), ("REJECT", "APPROVE"))
FINAL = ("APPROVE", "SUSPEND", "DENY")


def contingency(records: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of each pair of values that occurs."""
    return records.groupBy(left, right).agg(F.count("*").alias("n"))


def agreement(records: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of (credit decision, final decision), zero cells too; other values are left out."""
    cells = [(a, b) for a in EXPECTED for b in FINAL]
    counts = records.agg(*[F.count_if((F.col(left) == a) & (F.col(right) == b)).alias(f"n{k}") for k, (a, b) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(a).alias(left), F.lit(b).alias(right), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(cells)])
    return counts.select(F.inline(rows))


def off_diagonal(records: DataFrame, left: str, right: str) -> DataFrame:
    """Applications whose final decision isn't the one expected, and whether the two contradict each other."""
    known = records.where(F.col(left).isin(*EXPECTED) & F.col(right).isin(*FINAL))
    severe = F.lit(False)
    for a, b in SEVERE:
        severe = severe | ((F.col(left) == a) & (F.col(right) == b))
    return known.where(lookup(F.col(left), EXPECTED) != F.col(right)).select("application_id", left, right, severe.alias("severe"))


def agreement_rate(records: DataFrame, left: str, right: str) -> DataFrame:
    """How many applications have both decisions, and the share that agrees, in percent."""
    known = F.col(left).isin(*EXPECTED) & F.col(right).isin(*FINAL)
    known = F.coalesce(known, F.lit(False))
    agree = F.count_if(known & (lookup(F.col(left), EXPECTED) == F.col(right)))
    return records.agg(F.count_if(known).alias("compared"), F.count_if(~known).alias("skipped"), rounded(F.coalesce(F.try_divide(100.0 * agree, F.count_if(known)), F.lit(0.0)), 2).alias("agreement_rate_pct"))


def group_rates(records: DataFrame, group: str, decision: str) -> DataFrame:
    """Decided applications of each group with their favourable decisions by two definitions; blank groups are
    unknown."""
    value, d = F.trim(F.col(group).cast("string")), F.upper(F.trim(F.col(decision)))
    name = F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(value)
    return records.where(F.coalesce(d, F.lit("")) != "").groupBy(name.alias("audit_group")).agg(F.count("*").alias("n"), F.count_if(d == "APPROVE").alias("approve"), F.count_if(d.isin("APPROVE", "CONDITIONAL")).alias("approve_or_conditional"))


def adverse_impact(records: DataFrame, group: str, decision: str = "preliminary_decision", least: int = 30) -> DataFrame:
    """For each definition of favourable: the ratio of the lowest group's rate to the highest one's, the two
    groups (of equal rates the first by name), the four-fifths test, and the groups too small to tell. For
    audits alone: the group is no input of a decision."""
    rates = group_rates(records, group, decision)
    each = rates.select("audit_group", "n", F.inline(F.array(*[F.struct(F.lit(x).alias("favourable"), (F.col(x) / F.col("n")).alias("rate")) for x in ("approve", "approve_or_conditional")])))
    known = F.col("audit_group") != "unknown"
    order = lambda down: F.struct(F.when(known, F.col("rate")), F.col("audit_group")) if not down else F.struct(F.when(known, -F.col("rate")), F.col("audit_group"))
    found = each.where(known).groupBy("favourable").agg(F.count("*").alias("groups"), F.min(order(False)).alias("low"), F.min(order(True)).alias("high"), F.array_sort(F.collect_list(F.when(F.col("n") < least, F.col("audit_group")))).alias("small"))
    found = found.select("favourable", "groups", F.col("low.col1").alias("low_rate"), F.col("low.audit_group").alias("lowest"), (-F.col("high.col1")).alias("high_rate"), F.col("high.audit_group").alias("highest"), "small")
    usable = (F.col("groups") >= 2) & (F.col("high_rate") > 0)
    ratio = F.when(usable, F.try_divide("low_rate", "high_rate"))
    status = F.when(F.col("groups") < 2, "insufficient_groups").when(F.col("high_rate") == 0, "undefined_zero_favourable_rate").when(ratio < 0.8, "below_threshold").otherwise("ok")
    return found.select("favourable", rounded(ratio, 4).alias("air"), F.when(usable, F.col("lowest")).alias("lowest_group"), F.when(usable, F.col("highest")).alias("highest_group"), status.alias("status"), F.coalesce(ratio < 0.8, F.lit(False)).alias("flagged"), F.array_join("small", ",").alias("small_groups"))


#: Fields whose correction by a reviewer changes income or obligations.
WATCHED = ("average_monthly_salary_credit", "existing_debt", "gross_salary", "monthly_income", "net_salary", "total_monthly_obligations")


def upstream_quality(records: DataFrame, overrides: str) -> DataFrame:
    """Reviewed applications (overrides isn't null) and those where a watched field was corrected. overrides:
    an array of field names, empty where the reviewer changed nothing."""
    seen = F.col(overrides).isNotNull()
    hit = F.coalesce(F.arrays_overlap(overrides, F.array(*map(F.lit, WATCHED))), F.lit(False))
    return records.agg(F.count_if(seen).alias("reviewed"), F.count_if(~seen).alias("not_reviewed"), F.count_if(hit).alias("overridden"), percent(F.count_if(hit), F.count_if(seen)).alias("rate_pct"))


def upstream_fields(records: DataFrame, overrides: str) -> DataFrame:
    """How many reviewed applications had each watched field corrected, of those that occur."""
    return records.select(F.explode(F.array_intersect(overrides, F.array(*map(F.lit, WATCHED)))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def phase_one(records: DataFrame, group: str, overrides: str) -> DataFrame:
    """The portfolio report as tidy rows (metric, key, value), all from one table of assessed applications."""
    parts = [
        (source_mix(records), "bureau_source_pct", "source", "pct"), (flag_rates(records), "flag_pct", "flag", "pct"), (decision_distribution(records), "decision_n", "decision", "n"),
        (confidence_summary(records).select(F.lit("at_floor_pct").alias("k"), "at_floor_pct"), "confidence", "k", "at_floor_pct"),
        (upstream_quality(records, overrides).select(F.lit("rate_pct").alias("k"), "rate_pct"), "upstream", "k", "rate_pct"), (adverse_impact(records, group), "air", "favourable", "air"),
    ]
    out = None
    for df, metric, key, value in parts:
        rows = df.select(F.lit(metric).alias("metric"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def dashboard(applications: DataFrame) -> DataFrame:
    """Applications to review, all, mean seconds of processing, approvals among the decided (whole percent) and
    the sum of loans."""
    status = F.col("status")
    decided = F.count_if(status.isin("Approved", "Declined"))
    rate = rounded(F.try_divide(100.0 * F.count_if(status == "Approved"), decided), 0)
    return applications.agg(F.count_if(status == "Needs Review").alias("needs_review"), F.count("*").alias("total"), rounded(F.avg("processing_seconds"), 1).alias("average_seconds"), rate.alias("approval_rate_pct"), F.coalesce(F.sum(F.col("loan_amount").cast("decimal(20,2)")), F.lit(0)).cast("double").alias("portfolio_value"))


def by_score(records: DataFrame, score: str, bad: str) -> DataFrame:
    """Goods and bads of each distinct score: what all rank metrics are computed on."""
    return records.where(F.col(score).isNotNull() & F.col(bad).isin(0, 1)).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(bad) == 0).alias("good"), F.count_if(F.col(bad) == 1).alias("bad"))


#: Ranges of scores that are walked side by side.
PARTS = 64


def _walked(steps: DataFrame, order: str) -> DataFrame:
    """Sums of goods and bads up to each step, in the order of a number. The steps are cut into PARTS ranges of about as
    many steps each; sums are taken within each range and what the ranges below hold is added, so no task sees all steps.
    The steps are checkpointed: three branches read them."""
    c = F.col
    steps = cut(steps)
    cuts = steps.agg(F.percentile_approx(order, F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(10_000)).alias("_cuts"))
    parted = steps.join(F.broadcast(cuts)).withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda e: e < c(order))), F.lit(0))).drop("_cuts")
    sums = parted.groupBy("_part").agg(F.sum("good").alias("_good"), F.sum("bad").alias("_bad"))
    # PARTS rows at most on either side
    of = lambda n, below: F.coalesce(F.sum(F.when(c("y._part") < c("x._part"), c(f"y.{n}")) if below else c(f"y.{n}")), F.lit(0))
    before = sums.alias("x").join(F.broadcast(sums.alias("y"))).groupBy("x._part").agg(of("_good", True).alias("_good"), of("_bad", True).alias("_bad"), of("_good", False).alias("goods"), of("_bad", False).alias("bads"))
    w = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = parted.join(F.broadcast(before), "_part")
    return df.withColumns({"cum_good": F.sum("good").over(w) + c("_good"), "cum_bad": F.sum("bad").over(w) + c("_bad")}).drop("_part", "_good", "_bad")


def _distance() -> Column:
    return F.max(F.abs(F.try_divide("cum_bad", "bads") - F.try_divide("cum_good", "goods")))


def discrimination(records: DataFrame, score: str, bad: str) -> DataFrame:
    """AUC (a good scores above a bad, ties half), Gini and exact KS, with how good they are."""
    steps = _walked(by_score(records, score, bad), "score")
    wins = F.sum(F.col("good") * (F.col("cum_bad") - F.col("bad")) + F.col("good") * F.col("bad") / 2)
    auc = F.try_divide(wins, F.max(F.col("goods") * F.col("bads")))
    found = steps.agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), rounded(auc, 6).alias("auc"), rounded(2 * auc - 1, 6).alias("gini"), rounded(_distance(), 6).alias("ks"))
    return found.withColumns({"auc_status": F.when(F.col("auc") > 0.8, "good").when(F.col("auc") > 0.7, "acceptable").when(F.col("auc").isNotNull(), "weak"), "ks_status": ks_status(F.col("ks"))})


def ks_status(ks: Column) -> Column:
    return F.when(ks * 100 > 25, "good").when(ks * 100 >= 20, "acceptable").when(ks.isNotNull(), "weak")


def band(score: str, edges: tuple[float, ...]) -> Column:
    """The number of the band of a score on descending edges, 0 for the highest."""
    return sum((F.when(F.col(score) < e, 1).otherwise(0) for e in edges), F.lit(0))


def banded_ks(records: DataFrame, score: str, bad: str, edges: tuple[float, ...]) -> DataFrame:
    """KS over bands of descending edges, from the top; null without both outcomes."""
    known = records.where(F.col(score).isNotNull() & F.col(bad).isin(0, 1))
    steps = known.groupBy(band(score, edges).alias("band")).agg(F.count_if(F.col(bad) == 0).alias("good"), F.count_if(F.col(bad) == 1).alias("bad"))
    found = _walked(steps, "band").agg(rounded(_distance(), 6).alias("ks_banded"))
    return found.withColumn("status", ks_status(F.col("ks_banded")))


def stability_index(records: DataFrame, score: str, is_baseline, edges: tuple[float, ...]) -> DataFrame:
    """PSI over descending band edges, one aggregation; only empty shares are raised, to 1e-4. Null where either
    side has no rows."""
    known = F.col(score).isNotNull()
    number = band(score, edges)
    sides = {"b": known & is_baseline, "c": known & ~is_baseline}
    counts = records.agg(*[F.count_if(holds & (number == k)).alias(f"{side}{k}") for side, holds in sides.items() for k in range(len(edges) + 1)])
    total = {side: sum((F.col(f"{side}{k}") for k in range(len(edges) + 1)), F.lit(0)) for side in sides}
    share = lambda side, k: F.when(F.col(f"{side}{k}") > 0, F.try_divide(F.col(f"{side}{k}"), total[side])).otherwise(1e-4)
    psi = sum(((share("c", k) - share("b", k)) * F.ln(share("c", k) / share("b", k)) for k in range(len(edges) + 1)), F.lit(0.0))
    out = counts.select(F.when((total["b"] > 0) & (total["c"] > 0), rounded(psi, 4)).alias("psi"), total["b"].alias("n_baseline"), total["c"].alias("n_current"))
    return out.withColumn("status", F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") <= 0.25, "moderate shift").when(F.col("psi").isNotNull(), "significant shift"))


def bad_rate_by_group(records: DataFrame, field: str, order: tuple[str, ...]) -> DataFrame:
    """Bad rate (percent) of each group in order, and whether it falls where it should rise; groups outside the
    order come with a null place."""
    place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(field)), F.lit(0)).cast("int")
    rates = records.where(F.col("outcome_bad").isin(0, 1)).groupBy(F.col(field).alias("group_name"), place.alias("place")).agg(F.count("*").alias("n"), F.sum("outcome_bad").alias("bad"))
    rates = rates.withColumn("bad_rate_pct", percent(F.col("bad"), F.col("n")))
    before = F.lag("bad_rate_pct").over(W.partitionBy(F.col("place").isNull()).orderBy("place"))
    return rates.select("group_name", "place", "n", "bad", "bad_rate_pct", F.coalesce(F.col("place").isNotNull() & (F.col("bad_rate_pct") < before), F.lit(False)).alias("violates"))


def calibration(records: DataFrame, edges: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9, 1.0001), tolerance: float = 0.10) -> DataFrame:
    """Stated confidence against how often definite calls (APPROVE, REJECT) came true, in buckets of the edges,
    empty ones too; one aggregation."""
    c, d = F.col("credit_confidence"), F.col("preliminary_decision")
    right = F.when(d == "APPROVE", F.col("outcome_bad") == 0).when(d == "REJECT", F.col("outcome_bad") == 1)
    known = F.col("outcome_bad").isin(0, 1) & right.isNotNull()
    inside = [F.coalesce(known & (c >= a) & (c < b), F.lit(False)) for a, b in zip(edges, edges[1:])]
    one = records.agg(*[x for k, holds in enumerate(inside) for x in (F.count_if(holds).alias(f"n{k}"), F.avg(F.when(holds, c)).alias(f"c{k}"), F.avg(F.when(holds, right.cast("int"))).alias(f"a{k}"))])
    rows = F.array(*[F.struct(F.lit(f"{a:.2f}-{min(b, 1.0):.2f}").alias("bucket"), F.col(f"n{k}").alias("n"), rounded(F.col(f"c{k}"), 3).alias("mean_confidence"), rounded(F.col(f"a{k}"), 3).alias("realised_correct"), rounded(F.col(f"c{k}") - F.col(f"a{k}"), 3).alias("gap"), (F.abs(F.col(f"c{k}") - F.col(f"a{k}")) <= tolerance).alias("well_calibrated")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    return one.select(F.inline(rows))


def outcome_report(records: DataFrame, score: str, bad: str, edges: tuple[float, ...]) -> DataFrame:
    """One row: labelled applications, AUC, Gini, KS by score and by band, and a warning where outcomes are few
    or of one kind; available is false, and the metrics null, without labels."""
    found = discrimination(records, score, bad).crossJoin(F.broadcast(banded_ks(records, score, bad, edges).select("ks_banded")))
    n, bads = F.coalesce(F.col("n_good") + F.col("n_bad"), F.lit(0)), F.coalesce("n_bad", F.lit(0))
    warning = F.when(n == 0, "No records carry an outcome label.").when((bads == 0) | (bads == n), "Only one outcome class present - AUC/KS undefined.").when(bads < 30, F.concat(F.lit("Only "), bads.cast("string"), F.lit(" Bad outcomes - estimates are unstable.")))
    four = lambda x: rounded(F.col(x), 4).alias(x)
    return found.select((n > 0).alias("available"), n.alias("n_labelled"), bads.alias("n_bad"), four("auc"), "auc_status", four("gini"), four("ks"), "ks_status", four("ks_banded"), warning.alias("warning"))


def confusion(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Counts of (actual, predicted), zero cells too."""
    dim = dimension(cases, "actual", labels).crossJoin(dimension(cases, "predicted", labels))
    counts = cases.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    return dim.join(F.broadcast(counts), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


#: The cost of calling the first the second.
COSTS = {("APPROVE", "DENY"): 2.0, ("APPROVE", "SUSPEND"): 1.0, ("DENY", "APPROVE"): 10.0, ("DENY", "SUSPEND"): 2.0, ("SUSPEND", "APPROVE"): 5.0, ("SUSPEND", "DENY"): 1.0}


def _per_class(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row: n, right, and of each label its support, calls and hits."""
    a, p = F.col("actual"), F.col("predicted")
    counts = [x for k, label in enumerate(labels) for x in (F.count_if(a == label).alias(f"s{k}"), F.count_if(p == label).alias(f"c{k}"), F.count_if((a == label) & (p == label)).alias(f"h{k}"))]
    cost = sum((F.when((a == x) & (p == y), F.lit(v)).otherwise(0.0) for (x, y), v in COSTS.items()), F.lit(0.0))
    known = a.isin(*labels) & p.isin(*labels)
    return cases.agg(F.count("*").alias("n"), F.count_if(a == p).alias("right"), F.sum(F.when(known, cost).otherwise(F.when(a == p, 0.0).otherwise(1.0))).alias("cost"), *counts)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores(k: int) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of the kth label; 0 where undefined."""
    hit, called, support = F.col(f"h{k}"), F.col(f"c{k}"), F.col(f"s{k}")
    return _ratio(hit, called), _ratio(hit, support), _ratio(2.0 * hit, called + support)


def class_report(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined. One aggregation."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"s{k}").alias("support"), *[rounded(x, 6).alias(n) for x, n in zip(_scores(k), ("precision", "recall", "f1"), strict=True)]) for k, label in enumerate(labels)])
    return _per_class(cases, labels).select(F.inline(rows))


def class_summary(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Accuracy, macro and weighted averages over the labels, balanced accuracy (the macro recall) and the mean
    cost of a call. Null metrics of an empty table."""
    one = _per_class(cases, labels)
    mean = lambda i: sum((_scores(k)[i] for k in range(len(labels))), F.lit(0.0)) / len(labels)
    weighted = lambda i: F.try_divide(sum((_scores(k)[i] * F.col(f"s{k}") for k in range(len(labels))), F.lit(0.0)), F.col("n"))
    names = ("precision", "recall", "f1")
    return one.select("n", rounded(F.try_divide("right", "n"), 6).alias("accuracy"), rounded(mean(1), 6).alias("balanced_accuracy"), *[rounded(mean(i), 6).alias(f"macro_{x}") for i, x in enumerate(names)], *[rounded(weighted(i), 6).alias(f"weighted_{x}") for i, x in enumerate(names)], rounded(F.try_divide("cost", "n"), 6).alias("cost_weighted_error"))


def brier(cases: DataFrame, confidence: str, right: str) -> DataFrame:
    return cases.agg(F.count("*").alias("n"), rounded(F.avg(F.pow(F.col(confidence) - F.col(right).cast("double"), 2.0)), 6).alias("brier"))


def reliability(cases: DataFrame, confidence: str, right: str, bins: int = 10) -> DataFrame:
    number = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return cases.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), rounded(F.avg(confidence), 6).alias("mean_confidence"), rounded(F.avg(F.col(right).cast("int")), 6).alias("accuracy"))


def calibration_error(cases: DataFrame, confidence: str, right: str, bins: int = 10) -> DataFrame:
    number = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    each = cases.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(right).cast("int")).alias("a"))
    return each.agg(rounded(F.try_divide(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))), F.sum("n")), 6).alias("ece"))


def calibration_bins(cases: DataFrame, confidence: str, right: str, bins: int = 5) -> DataFrame:
    """Equal bins of confidence with mean, accuracy and gap, empty ones with their middle as mean; one aggregation."""
    c = F.col(confidence)
    edges = [k / bins for k in range(bins + 1)]
    inside = [F.coalesce((c >= a) & ((c < b) | F.lit(k == bins - 1) & (c <= b)), F.lit(False)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    one = cases.agg(*[x for k, holds in enumerate(inside) for x in (F.count_if(holds).alias(f"n{k}"), F.avg(F.when(holds, c)).alias(f"c{k}"), F.avg(F.when(holds, F.col(right).cast("int"))).alias(f"a{k}"))])
    rows = F.array(*[F.struct(F.lit(f"{a:.2f} - {b:.2f}").alias("bin_range"), F.col(f"n{k}").alias("n"), F.coalesce(rounded(F.col(f"c{k}"), 4), F.lit((a + b) / 2)).alias("mean_confidence"), F.coalesce(rounded(F.col(f"a{k}"), 4), F.lit(0.0)).alias("accuracy"), F.coalesce(rounded(F.abs(F.col(f"c{k}") - F.col(f"a{k}")), 4), F.lit(0.0)).alias("gap")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    return one.select(F.inline(rows))


def gate_error(cases: DataFrame, confidence: str, right: str, threshold: float) -> DataFrame:
    passed = cases.where(F.col(confidence) >= threshold)
    return passed.agg(F.count("*").alias("passing"), F.coalesce(rounded(F.avg(1 - F.col(right).cast("int")), 6), F.lit(0.0)).alias("gate_error"))


def threshold_sweep(cases: DataFrame, confidence: str, right: str) -> DataFrame:
    """Counts at each threshold from 0.50 to 0.95: one aggregation of percent bins, then cumulative sums."""
    percent = F.floor(F.col(confidence) * 100 + 1e-9).cast("int")
    bins = cases.groupBy(percent.alias("p")).agg(F.count_if(right).alias("good"), F.count_if(~F.col(right)).alias("bad"))
    thresholds = cases.sparkSession.range(50, 96).select(F.col("id").cast("int").alias("threshold_pct"))
    at = F.broadcast(thresholds).join(bins, F.lit(True)).groupBy("threshold_pct").agg(
        F.sum(F.when(F.col("p") >= F.col("threshold_pct"), F.col("good")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") >= F.col("threshold_pct"), F.col("bad")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("p") < F.col("threshold_pct"), F.col("bad")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("p") < F.col("threshold_pct"), F.col("good")).otherwise(0)).alias("fn"),
    )
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return at.select("threshold_pct", "tp", "fp", "tn", "fn", rounded(div(tp + fp, tp + fp + tn + fn), 6).alias("stp"), rounded(div(fp, tp + fp), 6).alias("gate_error"), rounded(div(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), rounded(div(tp, tp + fn) + div(tn, tn + fp) - 1, 6).alias("youden_j"))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the best Youden J, and the lowest one that passes something and no error."""
    clean = (F.col("gate_error") == 0) & (F.col("tp") + F.col("fp") > 0)
    return sweep.agg(F.max_by("threshold_pct", F.struct("youden_j", -F.col("threshold_pct"))).alias("best_j_threshold_pct"), F.max("youden_j").alias("best_j"), F.min(F.when(clean, F.col("threshold_pct"))).alias("zero_error_threshold_pct"))


def runtime_metrics(audit: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Decision distribution, rates and agreement over an audit log, one row."""
    d = F.col("decision")
    share = lambda condition: rounded(F.avg(condition.cast("int")), 6)
    agree = F.when(F.col("underwriter_rec").isNotNull() & F.col("analyst_rec").isNotNull(), (F.col("underwriter_rec") == F.col("analyst_rec")).cast("int"))
    return audit.agg(F.count("*").alias("n"), F.count_if(d == "APPROVE").alias("n_approve"), F.count_if(d == "DENY").alias("n_deny"), F.count_if(d == "SUSPEND").alias("n_suspend"), share(d == "SUSPEND").alias("suspend_rate"), share(d != "SUSPEND").alias("auto_rate"), rounded(F.avg("confidence"), 6).alias("mean_confidence"), share(F.col("confidence") < threshold).alias("below_threshold_rate"), rounded(F.avg(agree), 6).alias("agreement_rate"))


def gate_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.coalesce("gate_triggered", F.lit("none")).alias("gate")).agg(F.count("*").alias("n"))


def latest(audit: DataFrame) -> DataFrame:
    """The newest decision of each application."""
    return audit.groupBy("application_id").agg(F.max_by(F.struct("decision", "confidence"), "seq").alias("r"), F.max("seq").alias("seq")).select("application_id", "seq", "r.decision", "r.confidence")
