"""Likeness of names and token sequences, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table at a time. It takes
    size(a) * size(b) steps: meant for names and fields."""
    zeros = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(before: Column, x: Column) -> Column:
        cell = lambda acc, j: F.concat(acc, F.array(F.when(F.get(b, j - 1) == x, F.get(before, j - 1) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.get(before, j)))))
        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), cell)).otherwise(F.array(F.lit(0)))

    return F.element_at(F.aggregate(a, zeros, row), -1)


def edit_distance(a: Column, b: Column) -> Column:
    """Least number of insertions, deletions and substitutions between two arrays, row by row."""
    start = F.sequence(F.lit(0), F.size(b))

    def row(before: Column, x: Column) -> Column:
        cell = lambda acc, j: F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, F.get(before, j) + 1, F.get(before, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))))
        first = F.array(F.get(before, F.lit(0)) + 1)
        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), first, cell)).otherwise(first)

    return F.element_at(F.aggregate(a, start, row), -1)


def sorted_words(text: Column) -> Column:
    """The words of a text in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def bound(use: Callable[[Column], Column], **values: Column) -> Column:
    """use of a struct of the named values. They are worked out once for a row, not wherever use reads them, as they
    would be if they stood in its lambdas themselves."""
    one = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return F.get(F.transform(one, use), F.lit(0))


#: Letters that fit in the bits of one number.
BITS = 62


def _short_subsequence(a: Column, b: Column) -> Column:
    """common_subsequence where a has at most BITS elements: a row of the table is the bits of one number, and an
    element of b takes a handful of operations (bit-parallel, after Hyyro)."""
    one = F.lit(1).cast("long")
    place = lambda acc, z, x: F.struct((acc["bit"] * 2).alias("bit"), F.when(z == x, acc["mask"] + acc["bit"]).otherwise(acc["mask"]).alias("mask"))
    mask = lambda x: F.aggregate(a, F.struct(one.alias("bit"), F.lit(0).cast("long").alias("mask")), lambda acc, z: place(acc, z, x), lambda acc: acc["mask"])
    places = F.map_from_entries(F.transform(F.array_distinct(a), lambda x: F.struct(x, mask(x))))

    def row(s: Column) -> Column:
        def step(v: Column, x: Column) -> Column:
            hit = lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(s["full"])
            return F.coalesce(bound(lambda t: hit(t["u"]), u=v.bitwiseAND(F.element_at(s["places"], x))), v)

        return F.size(a) - F.bit_count(F.aggregate(b, s["full"], step))

    return bound(row, places=places, full=F.expr("0L") + F.call_function("shiftleft", one, F.size(a)) - 1)


def _ratio(x: Column, y: Column) -> Column:
    """200 times the common subsequence of two texts over their lengths together."""

    def of(s: Column) -> Column:
        short = F.size(s["p"]) <= BITS
        return F.try_divide(200.0 * F.when(short, _short_subsequence(s["p"], s["q"])).otherwise(common_subsequence(s["p"], s["q"])), F.size(s["p"]) + F.size(s["q"]))

    return bound(of, p=_letters(x), q=_letters(y))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 100: 200 times the common subsequence of the sorted words over their lengths together. Equal word
    sets give 100 without it."""
    return bound(lambda s: F.when(s["x"] == s["y"], 100.0).otherwise(_ratio(s["x"], s["y"])), x=sorted_words(a), y=sorted_words(b))


def token_sort_reaches(a: Column, b: Column, least: float) -> Column:
    """Whether token_sort_ratio is at least so high; lengths that rule it out are told without the ratio."""
    n, m = (lambda s: F.char_length(s["x"])), (lambda s: F.char_length(s["y"]))
    far = lambda s: 200.0 * F.least(n(s), m(s)) < least * (n(s) + m(s))
    return bound(lambda s: F.when(s["x"] == s["y"], F.lit(100.0 >= least)).when(far(s), False).otherwise(_ratio(s["x"], s["y"]) >= least), x=sorted_words(a), y=sorted_words(b))
