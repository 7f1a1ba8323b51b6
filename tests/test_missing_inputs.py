"""Applications without case inputs or without a credit assessment are suspended, not lost."""

from loanloom.fixtures import view
from loanloom.operators import decision
from loanloom.plans.credit import assessed

SF = "/root/testdata/sf0.001"


def test_missing_inputs_are_suspended(spark):
    credit, cases = assessed(spark, SF), view(spark, SF, "case_inputs")
    a, b, c = (r[0] for r in credit.select("application_id").join(cases.select("application_id"), "application_id").orderBy("application_id").limit(3).collect())
    few = decision.decided(credit.where(credit["application_id"].isin(a, c)), cases.where(cases["application_id"].isin(b, c)))
    got = {r["application_id"]: r for r in few.collect()}
    assert set(got) == {a, b, c} and got[c]["gate"] != "missing_inputs" and got[c]["part_credit"] is not None
    for x in (a, b):
        r = got[x]
        assert (r["gate"], r["decision"], r["decision_score"], r["confidence"], r["risk_level"], r["human_review"]) == ("missing_inputs", "SUSPEND", 0.0, 0.0, "VERY_HIGH", True)
        assert r["part_credit"] is None
    joined = decision.joined_cases(credit.where(credit["application_id"].isin(a, c)), cases.where(cases["application_id"].isin(b, c)))
    assert decision.contradictions(joined).where(f"application_id in ('{a}', '{b}')").count() == 0
