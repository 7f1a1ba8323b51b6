"""Entire licence texts in their variants, and odd rows."""

from loanloom.llm import license_scan


def test_entire_texts_in_variants(spark):
    rows = []
    for k, (name, texts) in enumerate(license_scan.TEXTS.items()):
        longest = max(texts, key=len)
        rows.append((k, f"Copyright (c) 2020 Someone\n\n{longest.upper().replace('LICENSE', 'LICENCE')}\n"))
        rows.append((100 + k, longest.replace(".", " . ").replace("\n", "\n\n")))
        rows.append((200 + k, longest + " and more"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan(table, license_scan.known_texts(spark)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add(r["license"])
    for k, name in enumerate(license_scan.TEXTS):
        assert name in by[k] and name in by[100 + k] and name not in by.get(200 + k, ())


def test_odd_rows(spark, monkeypatch, tmp_path):
    known = spark.createDataFrame([("A", "one two"), ("B", "One, two!"), ("C", None), ("D", "© 2020 x")], "license string, text string")
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "ONE\ttwo"), (4, "x\n" * 20_000 + "one-two\none two"), (5, "one two three")]
    table = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, license string")
    due = sorted([(0, "line", 0), (1, "line", 0), (1, "line", 0), (4, "line", 20_000), (4, "line", 20_001)])
    shape = lambda df: sorted((r["doc_id"] or 0, r["unit"], r["position"]) for r in df.collect())
    found = license_scan.scan(table, known)
    assert shape(found) == due and {r["license"] for r in found.collect()} == {"A"}
    monkeypatch.setattr(license_scan, "KNOWN", 0)  # the shuffled join
    assert shape(license_scan.scan(table, known)) == due
    assert license_scan.scan(table.where("false"), known).count() == 0
    assert license_scan.scan(table, known.where("false")).count() == 0
    known.write.parquet(str(tmp_path / "known"))
    assert license_scan.known_texts(spark, str(tmp_path / "known")).where("license = 'A'").count() == 1
