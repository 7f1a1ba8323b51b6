"""Whole reports and their SQL, put together from the SQL of their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.fixtures import oracle, view
from loanloom.operators import evaluation as e
from loanloom.plans import monitoring as m
from loanloom.plans.credit import CREDIT_SQL, assessed
from loanloom.plans.sql import r

TIERS = ("low", "moderate", "high")


def a45_full_evaluation(s, d):
    scored = m.cases(s, d).join(assessed(s, d).select("application_id", "risk_score"), "application_id")
    return e.decisions(scored, view(s, d, "audit_log"), m.LABELS)


def a29_outcome_sections(s, d):
    return e.outcomes(assessed(s, d), m.BANDS, TIERS, m.EDGES)


def a08_portfolio_report(s, d):
    """A rule on score and loan-to-value stands for the final decision."""
    final = m.cases(s, d).select("application_id", F.col("actual").alias("final_decision"))
    return e.portfolio(m.reviewed(s, d).join(final, "application_id"), "audit_group", "overrides", "final_decision")


QUERIES = {f.__name__: f for f in (a45_full_evaluation, a29_outcome_sections, a08_portfolio_report)}


def _tidy(section, sql, *names, key=None):
    called = [f"'{n}'" if key is None else f"concat({key}, '.{n}')" for n in names]
    rows = ", ".join(f"{{'metric': {c}, 'value': CAST({n} AS DOUBLE)}}" for c, n in zip(called, names, strict=True))
    return f"SELECT '{section}' AS section, x.metric AS metric, x.value AS value FROM (SELECT unnest([{rows}]) AS x FROM ({sql}))"


def _report(*parts):
    return " UNION ALL ".join(parts)


_DENIED = "SELECT c.risk_score, CAST(k.actual = 'DENY' AS INT) AS outcome_bad FROM credit c JOIN cases k ON k.application_id = c.application_id"
_RANKED = oracle(m._DISCRIMINATION.replace("FROM credit", "FROM denied"), "applications", credit=CREDIT_SQL, cases=m._CASES, denied=_DENIED)
_EXPECTED = "CASE preliminary_decision WHEN 'APPROVE' THEN 'APPROVE' WHEN 'CONDITIONAL' THEN 'SUSPEND' WHEN 'REJECT' THEN 'DENY' END"
_FINAL = "SELECT c.preliminary_decision, k.actual AS final_decision FROM credit c JOIN cases k ON k.application_id = c.application_id"
_TABLE = f"""SELECT a.x AS preliminary_decision, b.x AS final_decision, count(f.final_decision) AS n
FROM (VALUES ('APPROVE'), ('CONDITIONAL'), ('REJECT')) a(x) CROSS JOIN (VALUES ('APPROVE'), ('SUSPEND'), ('DENY')) b(x)
LEFT JOIN ({_FINAL}) f ON f.preliminary_decision = a.x AND f.final_decision = b.x GROUP BY 1, 2"""
_KNOWN = f"({_EXPECTED}) IS NOT NULL"
_RATE = f"""SELECT count(*) FILTER (WHERE {_KNOWN}) AS compared, count(*) FILTER (WHERE NOT {_KNOWN}) AS skipped,
{r(f"100.0::DOUBLE * count(*) FILTER (WHERE {_EXPECTED} = final_decision) / count(*) FILTER (WHERE {_KNOWN})", 2)} AS agreement_rate_pct FROM ({_FINAL})"""


def _cases(sql):
    return oracle(sql, "applications", credit=CREDIT_SQL, cases=m._CASES)


def _credit(sql):
    return oracle(sql, "applications", credit=CREDIT_SQL)


_O = m.ORACLE
ORACLE = {
    "a45_full_evaluation": _report(
        _tidy("summary", _O["a31_class_summary"], *e.SUMMARY),
        _tidy("class", _O["a31_class_report"], *e.CLASS, key="label"),
        _tidy("confusion", _O["a30_confusion"], "n", key="actual, '>', predicted"),
        _tidy("ranking", _RANKED, *e.RANKING),
        _tidy("confidence", _O["a34_brier"], "brier"),
        _tidy("confidence", _O["a36_ece"], "ece"),
        _tidy("reliability", _O["a35_reliability"], *e.BIN, key="bin"),
        _tidy("runtime", _O["a09_runtime_metrics"], *e.RUNTIME),
        _tidy("gate", _O["a09_gate_counts"], "n", key="gate"),
    ),
    "a29_outcome_sections": _report(
        _tidy("outcome", _O["a29_outcome_report"], *e.OUTCOME),
        _tidy("band", _O["a27_bad_rate_by_band"], *e.GROUP, key="coalesce(group_name, 'none')"),
        _tidy("tier", _O["a27_bad_rate_by_tier"], *e.GROUP, key="coalesce(group_name, 'none')"),
        _tidy("calibration", _O["a28_calibration"], *e.BUCKET, key="bucket"),
    ),
    "a08_portfolio_report": _report(
        _tidy("source", _O["a01_source_mix"], "n", "pct", key="source"),
        _tidy("flag", _O["a02_flag_rates"], "n", "pct", key="flag"),
        _tidy("decision", _O["a03_decision_distribution"], "n", "pct", key="decision"),
        _tidy("floor", _O["a04_confidence_summary"], *e.FLOOR),
        _tidy("bin", _O["a04_confidence_bins"], "n", "pct", key="bin"),
        _tidy("agreement", _cases(_TABLE), "n", key="preliminary_decision, '>', final_decision"),
        _tidy("agreement", _cases(_RATE), *e.AGREEMENT),
        _tidy("upstream", _O["a06_upstream_quality"], *e.UPSTREAM),
        _tidy("upstream_field", _O["a06_upstream_fields"], "n", key="field"),
        _tidy("impact", _credit(m._AIR), "air", "flagged", key="favourable"),
    ),
}
