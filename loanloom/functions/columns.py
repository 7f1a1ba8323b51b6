"""Small column helpers."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Rounds half up on ten decimal places, so that binary noise doesn't decide ties."""
    return F.round(x.cast("decimal(20,10)"), places).cast("double")


#: What a text must have for each part of a date format to be read from it.
_PARTS = {"yyyy": r"[+-]?[0-9]{4,}", "yy": r"[0-9]{2}", "MMMM": f"(?:{'|'.join(calendar.month_name[1:])})", "MMM": f"(?:{'|'.join(calendar.month_abbr[1:])})", "M": r"[+-]?[0-9]+", "d": r"[+-]?[0-9]+"}


def dated(text: Column, form: str) -> Column:
    """try_to_date(text, form). Texts of another form are told by their shape: a date that can't be read throws inside,
    for each row and format, which costs more than all else."""
    shape = "".join(_PARTS.get(part, re.escape(part)) for part in re.findall(r"yyyy|yy|MMMM|MMM|M|d|.", form))
    return F.when(text.rlike(f"(?i)^{shape}$"), F.try_to_date(text, form))


def lookup(key: Column, table: dict, default: object = None) -> Column:
    found = F.element_at(F.create_map([F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def joined(codes: Column) -> Column:
    """An array of strings as one comma-separated string."""
    return F.concat_ws(",", codes)


def present(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(condition, F.lit(code)) for condition, code in pairs]), lambda x: x.isNotNull())
