"""Whole reports by hand, over empty tables, and scanning what they assess once."""

from loanloom.operators import evaluation as e
from loanloom.plans import monitoring as m

CASES = "actual string, predicted string, confidence double, right boolean, risk_score double, extra string"
AUDIT = "decision string, confidence double, underwriter_rec string, analyst_rec string, gate_triggered string"


def report(df):
    return {(r["section"], r["metric"]): r["value"] for r in df.collect()}


def test_decisions_by_hand(spark):
    rows = [("APPROVE", "APPROVE", 0.95, True, 80.0, "x"), ("APPROVE", "DENY", 0.55, False, 70.0, "x"), ("DENY", "DENY", 0.85, True, 20.0, None), ("SUSPEND", "SUSPEND", 0.65, True, 20.0, "x")]
    log = [("DENY", 0.9, "DENY", "DENY", None), ("SUSPEND", 0.5, "DENY", None, "ltv")]
    got = report(e.decisions(spark.createDataFrame(rows, CASES), spark.createDataFrame(log, AUDIT), m.LABELS))
    assert got["summary", "accuracy"] == 0.75 and got["summary", "cost_weighted_error"] == 0.5
    assert got["class", "DENY.precision"] == 0.5 and got["class", "DENY.recall"] == 1.0
    assert got["confusion", "APPROVE>DENY.n"] == 1 and got["confusion", "DENY>APPROVE.n"] == 0
    assert got["ranking", "auc"] == round(2.5 / 3, 6)  # two above the denied one, one tied with it
    assert got["confidence", "brier"] == round((0.05**2 + 0.55**2 + 0.15**2 + 0.35**2) / 4, 6)
    assert got["reliability", "5.accuracy"] == 0.0 and got["reliability", "9.n"] == 1
    assert got["runtime", "agreement_rate"] == 1.0 and got["gate", "none.n"] == 1 == got["gate", "ltv.n"]


def test_empty_tables(spark):
    got = report(e.decisions(spark.createDataFrame([], CASES), spark.createDataFrame([], AUDIT), m.LABELS))
    assert got["summary", "n"] == 0 and got["summary", "accuracy"] is None and got["confusion", "DENY>DENY.n"] == 0
    assert got["ranking", "auc"] is None and not any(section in ("reliability", "gate") for section, _ in got)
    assert got["runtime", "n"] == 0 and got["runtime", "suspend_rate"] is None


def test_sources_are_cut_off(spark):
    """The plan of the report reads the cut tables alone: nothing of the source is planned once a section."""
    rows = spark.createDataFrame([("APPROVE", "APPROVE", 0.9, True, 50.0, "a")], CASES).withColumnRenamed("extra", "from_the_source")
    plan = e.decisions(rows, spark.createDataFrame([], AUDIT), m.LABELS)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_the_source" not in plan
