"""Review items are worked out once, however many steps ask for them."""

from loanloom.plans import decisions

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_review_items_are_found_once(spark):
    assert optimized(decisions.a65_review_items(spark, SF)).count("reported by the documents") == 1
