"""Pieces of DuckDB SQL that several families share."""

from __future__ import annotations


def r(x: str, places: int) -> str:
    """x rounded as functions.columns.rounded does."""
    return f"CAST(round(CAST({x} AS DECIMAL(20,10)), {places}) AS DOUBLE)"


def values(*names: str) -> str:
    """A one-column relation of the names, to be given an alias."""
    return "(VALUES " + ", ".join(f"('{x}')" for x in names) + ")"


def sorted_words(text: str) -> str:
    return f"array_to_string(list_sort([w for w in string_split_regex({text}, '\\s+') if w <> '']), ' ')"


def subsequence(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, row by row of its table."""
    cell = f"list_append(acc, CASE WHEN x[1] = unicode({b}[j[1]]) THEN before[j[1]] + 1 ELSE greatest(acc[len(acc)], before[j[1] + 1]) END)"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: {cell}, [0::BIGINT])"
    return f"(list_reduce(list_transform(string_split({a}, ''), lambda x: [unicode(x)::BIGINT]), lambda before, x: {row}, list_transform(range(0, length({b}) + 1), lambda v: 0::BIGINT)))[-1]"


def name_similarity(source: str, a: str, b: str) -> str:
    """source with the similarity of names a and b, as operators.texts.name_similarity gives it."""
    clean = "trim(regexp_replace(lower({}), '[^a-z0-9\\s]', '', 'g'))"
    words = "list_distinct([w for w in string_split_regex({}, '\\s+') if w <> ''])"
    prefix = "len([i for i in range(1, least(length(x), length(y)) + 1) if left(x, i) = left(y, i)])"
    initials = "list_sum(flatten([[CASE WHEN (length(s) = 1 AND starts_with(t, s)) OR (length(t) = 1 AND starts_with(s, t)) THEN 1 ELSE 0 END for t in q] for s in p]))"
    score = r(f"least(1, 0.7::DOUBLE * (len(list_intersect(p, q)) + 0.5::DOUBLE * {initials}) / greatest(len(p), len(q)) + 0.3::DOUBLE * ({prefix} + least(length(x), length(y))) / (length(x) + length(y)))", 3)
    return f"""SELECT *, CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0 WHEN x = y THEN 1 WHEN len(p) = 0 OR len(q) = 0 THEN 0 ELSE {score} END AS similarity FROM (
 SELECT *, {words.format("x")} AS p, {words.format("y")} AS q FROM (SELECT *, {clean.format(a)} AS x, {clean.format(b)} AS y FROM ({source})))"""


def edits(p: str, q: str) -> str:
    """Edit distance of two lists of texts, row by row of its table."""
    cell = f"list_append(acc, least(acc[len(acc)] + 1, before[j[1] + 1] + 1, before[j[1]] + CASE WHEN {p}[i[1]] = {q}[j[1]] THEN 0 ELSE 1 END))"
    row = f"list_reduce(list_transform(range(1, len({q}) + 1), lambda j: [j]), lambda acc, j: {cell}, [before[1] + 1])"
    return f"(list_reduce(list_transform(range(1, len({p}) + 1), lambda i: [i]), lambda before, i: {row}, list_transform(range(0, len({q}) + 1), lambda v: v)))[-1]"
