"""Names, fields and numbers by hand."""

from loanloom.operators import texts


def values(spark, rows, make):
    df = spark.createDataFrame(rows, "a string, b string")
    return [r[0] for r in df.select(make(df["a"], df["b"])).collect()]


def test_name_similarity(spark):
    rows = [("Mira Solvani", "mira solvani."), ("M. Solvani", "Mira Solvani"), (None, "x"), ("", ""), ("--", "ab"), ("Tara", "Nikhil")]
    # one shared word and one initial of two words; a prefix of 1, lengths 9 and 12
    assert values(spark, rows, texts.name_similarity) == [1.0, round(0.7 * 0.75 + 0.3 * 10 / 21, 3), 0.0, 0.0, 0.0, round(0.3 * 4 / 10, 3)]


def test_word_f1(spark):
    rows = [("a b b", "b b c"), (None, ""), ("a", None), ("A, b!", "a B")]
    assert values(spark, rows, texts.word_f1) == [0.6667, 1.0, 0.0, 1.0]


def test_numbers(spark):
    rows = [("XXXX-XXXX-1234", " abcd0123456 "), ("1234 5678 9012", "abcd1123456"), ("2345 6789 0123", None), (None, "")]
    assert values(spark, rows, lambda a, b: texts.national_number_valid(a)) == [True, False, True, False]
    assert values(spark, rows, lambda a, b: texts.branch_code_valid(b)) == [True, False, False, False]


def test_city(spark):
    rows = [(" bangalore", ""), ("NEW DELHI", ""), ("erode", ""), (" ", ""), (None, "")]
    assert values(spark, rows, lambda a, b: texts.city(a)) == ["Bengaluru", "Delhi", "Erode", None, None]
