"""Monitoring queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import once, oracle, view
from loanloom.operators import monitoring as m
from loanloom.plans.credit import CREDIT_SQL, assessed
from loanloom.plans.sql import r, values

BANDS = ("Excellent", "Good", "Fair", "Poor", "Very Poor")
EDGES = (90.0, 80.0, 70.0, 60.0, 50.0, 40.0)
LABELS = ("APPROVE", "DENY", "SUSPEND")


@once
def cases(spark, sf_dir):
    """Credit decisions as predictions, a rule on score and loan-to-value as the truth."""
    c = F.col
    actual = F.when(c("cibil_score").isNull(), "SUSPEND").when((c("cibil_score") >= 680) & (c("ltv_pct") <= 90), "APPROVE").when(c("cibil_score") < 580, "DENY").otherwise("SUSPEND")
    predicted = F.when(c("preliminary_decision") == "APPROVE", "APPROVE").when(c("preliminary_decision") == "REJECT", "DENY").otherwise("SUSPEND")
    df = assessed(spark, sf_dir).select("application_id", actual.alias("actual"), predicted.alias("predicted"), c("credit_confidence").alias("confidence"))
    return df.withColumn("right", c("actual") == c("predicted"))


_CASES = """SELECT *, actual = predicted AS ok FROM (SELECT application_id, CASE WHEN cibil_score IS NULL THEN 'SUSPEND' WHEN cibil_score >= 680 AND ltv_pct <= 90 THEN 'APPROVE' WHEN cibil_score < 580 THEN 'DENY' ELSE 'SUSPEND' END AS actual,
 CASE preliminary_decision WHEN 'APPROVE' THEN 'APPROVE' WHEN 'REJECT' THEN 'DENY' ELSE 'SUSPEND' END AS predicted, credit_confidence AS confidence FROM credit)"""


def baseline():
    return F.col("created_at") < F.lit("2000-01-01").cast("timestamp")


@once
def reviewed(s, d):
    """Assessed applications with what reviewers corrected."""
    fields = F.when(F.col("overridden_fields") == "", F.array().cast("array<string>")).otherwise(F.split("overridden_fields", ","))
    corrections = view(s, d, "case_inputs").select("application_id", fields.alias("overrides"))
    return assessed(s, d).join(corrections, "application_id")


def processed(s, d):
    """Applications with the status a dashboard shows."""
    status = F.when(F.col("preliminary_decision") == "APPROVE", "Approved").when(F.col("preliminary_decision") == "REJECT", "Declined").otherwise("Needs Review")
    return assessed(s, d).select(status.alias("status"), (1.0 + F.col("application_id") % 13).alias("processing_seconds"), "loan_amount")


def credit_bands(s, d):
    return m.bad_rate_by_group(assessed(s, d), "credit_band", BANDS)


def risk_tiers(s, d):
    return m.bad_rate_by_group(assessed(s, d), "risk_tier", ("low", "moderate", "high"))


QUERIES = {
    "a01_source_mix": lambda s, d: m.source_mix(view(s, d, "applications")),
    "a01_source_summary": lambda s, d: m.source_summary(view(s, d, "applications")),
    "a02_flag_rates": lambda s, d: m.flag_rates(assessed(s, d)),
    "a03_decision_distribution": lambda s, d: m.decision_distribution(assessed(s, d)),
    "a04_confidence_bins": lambda s, d: m.confidence_bins(assessed(s, d)),
    "a04_confidence_summary": lambda s, d: m.confidence_summary(assessed(s, d)),
    "a05_agreement": lambda s, d: m.contingency(cases(s, d), "predicted", "actual"),
    "a06_upstream_quality": lambda s, d: m.upstream_quality(reviewed(s, d), "overrides"),
    "a06_upstream_fields": lambda s, d: m.upstream_fields(reviewed(s, d), "overrides"),
    "a07_group_rates": lambda s, d: m.group_rates(assessed(s, d), "audit_group", "preliminary_decision"),
    "a07_adverse_impact": lambda s, d: m.adverse_impact(assessed(s, d), "audit_group"),
    "a08_phase_one": lambda s, d: m.phase_one(reviewed(s, d), "audit_group", "overrides"),
    "a09_runtime_metrics": lambda s, d: m.runtime_metrics(view(s, d, "audit_log")),
    "a09_gate_counts": lambda s, d: m.gate_counts(view(s, d, "audit_log")),
    "a12_dashboard": lambda s, d: m.dashboard(processed(s, d)),
    "a22_psi": lambda s, d: m.stability_index(assessed(s, d), "risk_score", baseline(), EDGES),
    "a23_discrimination": lambda s, d: m.discrimination(assessed(s, d), "risk_score", "outcome_bad"),
    "a25_banded_ks": lambda s, d: m.banded_ks(assessed(s, d), "risk_score", "outcome_bad", EDGES),
    "a27_bad_rate_by_band": credit_bands,
    "a27_bad_rate_by_tier": risk_tiers,
    "a28_calibration": lambda s, d: m.calibration(assessed(s, d)),
    "a29_outcome_report": lambda s, d: m.outcome_report(assessed(s, d), "risk_score", "outcome_bad", EDGES),
    "a30_confusion": lambda s, d: m.confusion(cases(s, d), LABELS),
    "a31_class_report": lambda s, d: m.class_report(cases(s, d), LABELS),
    "a31_class_summary": lambda s, d: m.class_summary(cases(s, d), LABELS),
    "a34_brier": lambda s, d: m.brier(cases(s, d), "confidence", "right"),
    "a35_reliability": lambda s, d: m.reliability(cases(s, d), "confidence", "right"),
    "a36_ece": lambda s, d: m.calibration_error(cases(s, d), "confidence", "right"),
    "a36_five_bins": lambda s, d: m.calibration_bins(cases(s, d), "confidence", "right"),
    "a37_gate_error": lambda s, d: m.gate_error(cases(s, d), "confidence", "right", 0.85),
    "a41_threshold_sweep": lambda s, d: m.threshold_sweep(cases(s, d), "confidence", "right"),
    "t05_best_thresholds": lambda s, d: m.best_thresholds(m.threshold_sweep(cases(s, d), "confidence", "right")),
    "w03_latest_decision": lambda s, d: m.latest(view(s, d, "audit_log")),
}

def pct(n, total):
    return f"coalesce({r(f'100.0::DOUBLE * {n} / nullif({total}, 0)', 2)}, 0)"


def _c(sql):
    return oracle(sql, "applications", credit=CREDIT_SQL)


def _k(sql):
    return oracle(sql, "applications", credit=CREDIT_SQL, cases=_CASES)


_BAND = "(" + " + ".join(f"CASE WHEN risk_score < {e} THEN 1 ELSE 0 END" for e in EDGES) + ")"
_SOURCES = ("bureau", "applicant_declared", "simulated", "demo_fixture", "unknown")
_KNOWN = "preliminary_decision IS NOT NULL"
_BIN = "greatest(0, least(19, floor(credit_confidence / 0.05::DOUBLE + 1e-9::DOUBLE)))"
_EXPECTED = r("greatest(0.3::DOUBLE, 0.9::DOUBLE - CASE WHEN cibil_score IS NULL THEN 0.3::DOUBLE ELSE 0 END - n_flags * 0.05::DOUBLE)", 2)
_GROUPS = "SELECT coalesce(nullif(trim(audit_group), ''), 'unknown') AS audit_group, count(*) AS n, count(*) FILTER (WHERE preliminary_decision = 'APPROVE') AS approve, count(*) FILTER (WHERE preliminary_decision IN ('APPROVE', 'CONDITIONAL')) AS approve_or_conditional FROM credit WHERE preliminary_decision IS NOT NULL GROUP BY 1"
_AIR = f"""SELECT favourable, CASE WHEN groups >= 2 AND high > 0 THEN {r("low / high", 4)} END AS air, CASE WHEN groups >= 2 AND high > 0 THEN lowest END AS lowest_group, CASE WHEN groups >= 2 AND high > 0 THEN highest END AS highest_group,
 CASE WHEN groups < 2 THEN 'insufficient_groups' WHEN high = 0 THEN 'undefined_zero_favourable_rate' WHEN low / high < 0.8::DOUBLE THEN 'below_threshold' ELSE 'ok' END AS status, coalesce(groups >= 2 AND low / high < 0.8::DOUBLE, false) AS flagged, coalesce(small, '') AS small_groups FROM (
 SELECT favourable, count(*) AS groups, min(rate) AS low, max(rate) AS high, arg_min(audit_group, (rate, audit_group)) AS lowest, arg_min(audit_group, (-rate, audit_group)) AS highest, string_agg(CASE WHEN n < 30 THEN audit_group END, ',' ORDER BY audit_group) AS small FROM (
 SELECT audit_group, n, 'approve' AS favourable, approve / n::DOUBLE AS rate FROM ({_GROUPS}) UNION ALL SELECT audit_group, n, 'approve_or_conditional', approve_or_conditional / n::DOUBLE FROM ({_GROUPS})) WHERE audit_group <> 'unknown' GROUP BY 1)"""
_WATCHED = "[" + ", ".join(f"'{x}'" for x in m.WATCHED) + "]"
_HIT = f"list_has_any(string_split(overridden_fields, ','), {_WATCHED})"
_UPSTREAM = f"SELECT count(overridden_fields) AS reviewed, count(*) - count(overridden_fields) AS not_reviewed, count(*) FILTER (WHERE {_HIT}) AS overridden, {pct(f'count(*) FILTER (WHERE {_HIT})', 'count(overridden_fields)')} AS rate_pct FROM case_inputs"
_MIX = f"SELECT source, n, {pct('n', 'sum(n) OVER ()')} AS pct FROM (SELECT source, count(a.application_id) AS n FROM {values(*_SOURCES)} v(source) LEFT JOIN applications a ON coalesce(a.bureau_source, 'unknown') = source GROUP BY source)"
_RATES = f"SELECT flag, n, {pct('n', '(SELECT count(*) FROM credit)')} AS pct FROM (" + " UNION ALL ".join([*(f"SELECT '{x}' AS flag, count(*) FILTER (WHERE contains(flags, '{x}')) AS n FROM credit" for x in ("settled_account", "written_off_account", "dpd_over_90", "loan_stacking", "income_to_loan_mismatch")), "SELECT 'other', 0", "SELECT 'any', count(*) FILTER (WHERE n_flags > 0) FROM credit"]) + ")"
_DISTRIBUTION = f"SELECT decision, n, CASE WHEN decision <> 'missing' THEN {pct('n', f'(SELECT count(*) FROM credit WHERE {_KNOWN})')} END AS pct FROM (SELECT decision, count(c.application_id) AS n FROM {values('APPROVE', 'CONDITIONAL', 'REJECT', 'missing', 'other')} v(decision) LEFT JOIN credit c ON coalesce(c.preliminary_decision, 'missing') = decision GROUP BY decision)"
_LOW = "count(*) FILTER (WHERE credit_confidence <= 0.3::DOUBLE + 1e-9::DOUBLE)"
_FLOOR = f"SELECT count(*) AS n, {_LOW} AS at_floor, {pct(_LOW, 'count(*)')} AS at_floor_pct, {pct(_LOW, 'count(*)')} > 20 AS floor_alert, count(*) FILTER (WHERE abs({_EXPECTED} - credit_confidence) > 0.005::DOUBLE) AS formula_mismatches FROM credit WHERE {_KNOWN}"
_STEPS = "(SELECT *, (sum(good) OVER w)::DOUBLE AS cg, (sum(bad) OVER w)::DOUBLE AS cb, (sum(good) OVER ())::DOUBLE AS tg, (sum(bad) OVER ())::DOUBLE AS tb FROM (SELECT {0} AS step, count(*) FILTER (WHERE outcome_bad = 0) AS good, count(*) FILTER (WHERE outcome_bad = 1) AS bad FROM credit WHERE outcome_bad IS NOT NULL AND risk_score IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY step))"
_AUC = "sum(good * (cb - bad) + good * bad / 2.0::DOUBLE) / max(tg * tb)"


def ks_status(x):
    return f"CASE WHEN {x} * 100 > 25 THEN 'good' WHEN {x} * 100 >= 20 THEN 'acceptable' WHEN {x} IS NOT NULL THEN 'weak' END"


_DISCRIMINATION = f"SELECT *, CASE WHEN auc > 0.8 THEN 'good' WHEN auc > 0.7 THEN 'acceptable' WHEN auc IS NOT NULL THEN 'weak' END AS auc_status, {ks_status('ks')} AS ks_status FROM (SELECT CAST(sum(good) AS BIGINT) AS n_good, CAST(sum(bad) AS BIGINT) AS n_bad, {r(_AUC, 6)} AS auc, {r(f'2 * ({_AUC}) - 1', 6)} AS gini, {r('max(abs(cb / tb - cg / tg))', 6)} AS ks FROM {_STEPS.format('risk_score')})"
_BANDED = f"SELECT ks_banded, {ks_status('ks_banded')} AS status FROM (SELECT {r('max(abs(cb / tb - cg / tg))', 6)} AS ks_banded FROM {_STEPS.format(_BAND)})"


def _bad_rates(field, order):
    rate = pct("bad", "n")
    place = f"CAST(nullif(list_position([{', '.join(repr(x) for x in order)}], {field}), 0) AS INT)"
    return f"SELECT group_name, place, n, bad, {rate} AS bad_rate_pct, coalesce(place IS NOT NULL AND {rate} < lag({rate}) OVER (PARTITION BY place IS NULL ORDER BY place), false) AS violates FROM (SELECT {field} AS group_name, {place} AS place, count(*) AS n, CAST(sum(outcome_bad) AS BIGINT) AS bad FROM credit WHERE outcome_bad IS NOT NULL GROUP BY 1, 2)"


_EDGES = ((0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.0001))
_TRUE = "CASE preliminary_decision WHEN 'APPROVE' THEN outcome_bad = 0 WHEN 'REJECT' THEN outcome_bad = 1 END"
_MACRO = "(SELECT label, support, called, hit, coalesce(hit / nullif(called, 0)::DOUBLE, 0) AS p, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS q, coalesce(2.0::DOUBLE * hit / nullif(called + support, 0), 0) AS f FROM (SELECT label, count(*) FILTER (WHERE actual = label) AS support, count(*) FILTER (WHERE predicted = label) AS called, count(*) FILTER (WHERE actual = label AND predicted = label) AS hit FROM " + values(*LABELS) + " v(label) CROSS JOIN cases GROUP BY 1))"
_COST = "CASE " + " ".join(f"WHEN actual = '{a}' AND predicted = '{b}' THEN {v}" for (a, b), v in m.COSTS.items()) + " ELSE 0 END"
_SWEEP = f"SELECT threshold_pct, tp, fp, tn, fn, {r('(tp + fp) / (tp + fp + tn + fn)::DOUBLE', 6)} AS stp, {r('coalesce(fp / nullif(tp + fp, 0)::DOUBLE, 0)', 6)} AS gate_error, {r('(tp + tn) / (tp + fp + tn + fn)::DOUBLE', 6)} AS accuracy, {r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) - 1', 6)} AS youden_j FROM (SELECT CAST(t AS INT) AS threshold_pct, count(*) FILTER (WHERE floor(confidence * 100 + 1e-9) >= t AND ok) AS tp, count(*) FILTER (WHERE floor(confidence * 100 + 1e-9) >= t AND NOT ok) AS fp, count(*) FILTER (WHERE floor(confidence * 100 + 1e-9) < t AND NOT ok) AS tn, count(*) FILTER (WHERE floor(confidence * 100 + 1e-9) < t AND ok) AS fn FROM range(50, 96) x(t) CROSS JOIN cases GROUP BY 1)"
_FIVE = " UNION ALL ".join(f"SELECT '{k / 5:.2f} - {(k + 1) / 5:.2f}' AS bin_range, count(*) AS n, coalesce({r('avg(confidence)', 4)}, {(2 * k + 1) / 10}) AS mean_confidence, coalesce({r('avg(CAST(ok AS INT))', 4)}, 0) AS accuracy, coalesce({r('abs(avg(confidence) - avg(CAST(ok AS INT)))', 4)}, 0) AS gap FROM cases WHERE confidence >= {k / 5}::DOUBLE AND (confidence < {(k + 1) / 5}::DOUBLE {'OR confidence <= 1' if k == 4 else ''})" for k in range(5))
ORACLE = {
    "a01_source_mix": oracle(_MIX, "applications"),
    "a01_source_summary": oracle(f"SELECT count(*) AS total, {pct('count(*) FILTER (WHERE bureau_source = $$simulated$$)', 'count(*)')} AS simulated_share_pct, {pct('count(*) FILTER (WHERE bureau_source IN ($$applicant_declared$$, $$simulated$$, $$demo_fixture$$))', 'count(*)')} AS unverified_share_pct, count(*) > 0 AND count(*) FILTER (WHERE bureau_source = 'simulated') = 0 AS meets_production_target FROM applications", "applications"),
    "a02_flag_rates": _c(_RATES),
    "a03_decision_distribution": _c(_DISTRIBUTION),
    "a04_confidence_bins": _c(f"SELECT printf('%.2f-%.2f', k * 0.05::DOUBLE, (k + 1) * 0.05::DOUBLE) AS bin, count(application_id) AS n, {pct('count(application_id)', f'(SELECT count(*) FROM credit WHERE {_KNOWN})')} AS pct FROM range(20) t(k) LEFT JOIN credit ON {_KNOWN} AND {_BIN} = k GROUP BY k"),
    "a04_confidence_summary": _c(_FLOOR),
    "a06_upstream_quality": oracle(_UPSTREAM, "case_inputs"),
    "a06_upstream_fields": oracle(f"SELECT field, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(overridden_fields, ','))) AS field FROM case_inputs) WHERE list_contains({_WATCHED}, field) GROUP BY 1", "case_inputs"),
    "a07_group_rates": _c(_GROUPS),
    "a07_adverse_impact": _c(_AIR),
    "a08_phase_one": oracle(f"SELECT 'bureau_source_pct' AS metric, source AS key, pct AS value FROM ({_MIX}) UNION ALL SELECT 'flag_pct', flag, pct FROM ({_RATES}) UNION ALL SELECT 'decision_n', decision, n FROM ({_DISTRIBUTION}) UNION ALL SELECT 'confidence', 'at_floor_pct', at_floor_pct FROM ({_FLOOR}) UNION ALL SELECT 'upstream', 'rate_pct', rate_pct FROM ({_UPSTREAM}) UNION ALL SELECT 'air', favourable, air FROM ({_AIR})", "case_inputs", credit=CREDIT_SQL),
    "a12_dashboard": _c(f"SELECT count(*) FILTER (WHERE coalesce(preliminary_decision, '') NOT IN ('APPROVE', 'REJECT')) AS needs_review, count(*) AS total, {r('avg(1.0 + application_id % 13)', 1)} AS average_seconds, {r('100.0::DOUBLE * count(*) FILTER (WHERE preliminary_decision = $$APPROVE$$) / count(*) FILTER (WHERE preliminary_decision IN ($$APPROVE$$, $$REJECT$$))', 0)} AS approval_rate_pct, CAST(sum(CAST(loan_amount AS DECIMAL(20,2))) AS DOUBLE) AS portfolio_value FROM credit"),
    "a05_agreement": _k("SELECT predicted, actual, count(*) AS n FROM cases GROUP BY 1, 2"),
    "a09_runtime_metrics": oracle(f"SELECT count(*) AS n, count(*) FILTER (WHERE decision = 'APPROVE') AS n_approve, count(*) FILTER (WHERE decision = 'DENY') AS n_deny, count(*) FILTER (WHERE decision = 'SUSPEND') AS n_suspend, {r('avg(CAST(decision = $$SUSPEND$$ AS INT))', 6)} AS suspend_rate, {r('avg(CAST(decision <> $$SUSPEND$$ AS INT))', 6)} AS auto_rate, {r('avg(confidence)', 6)} AS mean_confidence, {r('avg(CAST(confidence < 0.85::DOUBLE AS INT))', 6)} AS below_threshold_rate, {r('avg(CAST(underwriter_rec = analyst_rec AS INT))', 6)} AS agreement_rate FROM audit_log", "audit_log"),
    "a09_gate_counts": oracle("SELECT coalesce(gate_triggered, 'none') AS gate, count(*) AS n FROM audit_log GROUP BY 1", "audit_log"),
    "a30_confusion": _k(f"SELECT a.x AS actual, p.x AS predicted, count(application_id) AS n FROM {values(*LABELS)} a(x) CROSS JOIN {values(*LABELS)} p(x) LEFT JOIN cases ON actual = a.x AND predicted = p.x GROUP BY 1, 2"),
    "a31_class_report": _k(f"SELECT label, support, {r('coalesce(hit / nullif(called, 0)::DOUBLE, 0)', 6)} AS precision, {r('coalesce(hit / nullif(support, 0)::DOUBLE, 0)', 6)} AS recall, {r('coalesce(2.0::DOUBLE * hit / nullif(called + support, 0), 0)', 6)} AS f1 FROM (SELECT label, count(*) FILTER (WHERE actual = label) AS support, count(*) FILTER (WHERE predicted = label) AS called, count(*) FILTER (WHERE actual = label AND predicted = label) AS hit FROM {values(*LABELS)} v(label) CROSS JOIN cases GROUP BY 1)"),
    "a34_brier": _k(f"SELECT count(*) AS n, {r('avg(pow(confidence - CAST(ok AS INT), 2))', 6)} AS brier FROM cases"),
    "a35_reliability": _k(f"SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, {r('avg(confidence)', 6)} AS mean_confidence, {r('avg(CAST(ok AS INT))', 6)} AS accuracy FROM cases GROUP BY 1"),
    "a36_ece": _k(f"SELECT {r('sum(n * abs(c - a)) / sum(n)', 6)} AS ece FROM (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(ok AS INT)) AS a FROM cases GROUP BY 1)"),
    "a37_gate_error": _k(f"SELECT count(*) AS passing, coalesce({r('avg(1 - CAST(ok AS INT))', 6)}, 0) AS gate_error FROM cases WHERE confidence >= 0.85::DOUBLE"),
    "a22_psi": _c(f"SELECT CASE WHEN nb > 0 AND nc > 0 THEN psi END AS psi, nb AS n_baseline, nc AS n_current, CASE WHEN nb = 0 OR nc = 0 THEN NULL WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate shift' ELSE 'significant shift' END AS status FROM (SELECT {r('sum((q - p) * ln(q / p))', 4)} AS psi, CAST(max(tb) AS BIGINT) AS nb, CAST(max(tc) AS BIGINT) AS nc FROM (SELECT CASE WHEN b > 0 THEN b / tb::DOUBLE ELSE 1e-4 END AS p, CASE WHEN c > 0 THEN c / tc::DOUBLE ELSE 1e-4 END AS q, tb, tc FROM (SELECT coalesce(b, 0) AS b, coalesce(c, 0) AS c, sum(b) OVER () AS tb, sum(c) OVER () AS tc FROM range({len(EDGES) + 1}) t(k) LEFT JOIN (SELECT {_BAND} AS band, count(*) FILTER (WHERE created_at < TIMESTAMP '2000-01-01') AS b, count(*) FILTER (WHERE NOT created_at < TIMESTAMP '2000-01-01') AS c FROM credit WHERE risk_score IS NOT NULL GROUP BY 1) ON band = k)))"),
    "a23_discrimination": _c(_DISCRIMINATION),
    "a25_banded_ks": _c(_BANDED),
    "a27_bad_rate_by_band": _c(_bad_rates("credit_band", BANDS)),
    "a27_bad_rate_by_tier": _c(_bad_rates("risk_tier", ("low", "moderate", "high"))),
    "a28_calibration": _c(" UNION ALL ".join(f"SELECT '{a:.2f}-{min(b, 1.0):.2f}' AS bucket, count(*) AS n, {r('avg(credit_confidence)', 3)} AS mean_confidence, {r(f'avg(CAST({_TRUE} AS INT))', 3)} AS realised_correct, {r(f'avg(credit_confidence) - avg(CAST({_TRUE} AS INT))', 3)} AS gap, abs(avg(credit_confidence) - avg(CAST({_TRUE} AS INT))) <= 0.1::DOUBLE AS well_calibrated FROM credit WHERE outcome_bad IS NOT NULL AND preliminary_decision IN ('APPROVE', 'REJECT') AND credit_confidence >= {a}::DOUBLE AND credit_confidence < {b}::DOUBLE" for a, b in _EDGES)),
    "a29_outcome_report": _c(f"SELECT n_good + n_bad > 0 AS available, n_good + n_bad AS n_labelled, n_bad, {r('auc', 4)} AS auc, auc_status, {r('gini', 4)} AS gini, {r('ks', 4)} AS ks, ks_status, {r('ks_banded', 4)} AS ks_banded, CASE WHEN n_bad = 0 OR n_good = 0 THEN 'Only one outcome class present - AUC/KS undefined.' WHEN n_bad < 30 THEN concat('Only ', n_bad, ' Bad outcomes - estimates are unstable.') END AS warning FROM ({_DISCRIMINATION}) CROSS JOIN (SELECT ks_banded FROM ({_BANDED}))"),
    "a31_class_summary": _k(f"SELECT n, {r('hits / n', 6)} AS accuracy, {r('mq', 6)} AS balanced_accuracy, {r('mp', 6)} AS macro_precision, {r('mq', 6)} AS macro_recall, {r('mf', 6)} AS macro_f1, {r('wp / n', 6)} AS weighted_precision, {r('wq / n', 6)} AS weighted_recall, {r('wf / n', 6)} AS weighted_f1, {r('cost / n', 6)} AS cost_weighted_error FROM (SELECT avg(p) AS mp, avg(q) AS mq, avg(f) AS mf, sum(p * support) AS wp, sum(q * support) AS wq, sum(f * support) AS wf FROM {_MACRO}) CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (WHERE ok)::DOUBLE AS hits, sum({_COST})::DOUBLE AS cost FROM cases)"),
    "a36_five_bins": _k(_FIVE),
    "a41_threshold_sweep": _k(_SWEEP),
    "t05_best_thresholds": _k(f"SELECT arg_max(threshold_pct, (youden_j, -threshold_pct)) AS best_j_threshold_pct, max(youden_j) AS best_j, min(CASE WHEN gate_error = 0 AND tp + fp > 0 THEN threshold_pct END) AS zero_error_threshold_pct FROM ({_SWEEP})"),
    "w03_latest_decision": oracle("SELECT application_id, max(seq) AS seq, max_by(decision, seq) AS decision, max_by(confidence, seq) AS confidence FROM audit_log GROUP BY 1", "audit_log"),
}
