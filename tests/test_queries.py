"""Every registered loan query against its SQL on the small tables."""

import duckdb
import pytest

from loanloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return str(v)


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=key)
    assert ours == theirs


def test_discrimination_by_hand(spark):
    from loanloom.operators.monitoring import discrimination

    rows = spark.createDataFrame([(90.0, 0), (80.0, 0), (70.0, 1), (70.0, 0), (60.0, 1), (50.0, None)], "s double, bad int")
    r = discrimination(rows, "s", "bad").first()
    assert (r["n_good"], r["n_bad"]) == (3, 2)
    assert r["auc"] == pytest.approx(5.5 / 6, abs=1e-6)  # (70, 70) counts half
    assert r["ks"] == pytest.approx(2 / 3, abs=1e-6)


def test_price_units(spark):
    from loanloom.operators.listings import price

    rows = spark.createDataFrame([("₹1.5 Cr",), ("Rs. 45,50,000",), ("45.5 lakh",), ("2 million",), ("on request",), (None,)], "t string")
    assert [r[0] for r in rows.select(price(rows["t"])).collect()] == [15_000_000.0, 4_550_000.0, 4_550_000.0, 2_000_000.0, None, None]


def test_imports_without_text_package():
    import __spark_entry__

    assert "a03_decision_distribution" in __spark_entry__.queries()
