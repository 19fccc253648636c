"""Month periods: ``yyyy_mm`` strings and their dates."""

from __future__ import annotations

import calendar
import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def split(period: str) -> tuple[int, int]:
    """(year, month) of ``yyyy_mm`` or ``yyyy-mm``; anything else is a ValueError."""
    found = re.fullmatch(r"(\d{4})[_-](\d{2})", period)
    if not found or not 1 <= int(found[2]) <= 12:
        raise ValueError(f"not a month: {period!r}")
    return int(found[1]), int(found[2])


def window(period: str) -> tuple[date, date]:
    """First and last day, both inside."""
    y, m = split(period)
    return date(y, m, 1), date(y, m, calendar.monthrange(y, m)[1])


def shift(period: str, months: int) -> str:
    y, m = split(period)
    y, m = divmod(y * 12 + m - 1 + months, 12)
    return f"{y:04d}_{m + 1:02d}"


def previous(period: str) -> str:
    return shift(period, -1)


def following(period: str, n: int) -> list[str]:
    return [shift(period, i) for i in range(1, n + 1)]


def between(first: str, last: str) -> list[str]:
    """All months from ``first`` to ``last``, both included."""
    out = []
    while first <= last:
        out.append(first)
        first = shift(first, 1)
    return out


def inside(column: str | Column, period: str) -> Column:
    first, last = window(period)
    return (F.col(column) if isinstance(column, str) else column).between(F.lit(first), F.lit(last))


def key(column: str | Column) -> Column:
    """``yyyy_mm`` of a date."""
    return F.date_format(column, "yyyy_MM")


def months_inclusive(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


#: Fixed value: an ISO date, with or without hyphens, and a time and offset behind it.
ISO_DATE = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?[0-5]\d){0,2})?)?$"


def tolerant_date(c: str | Column) -> Column:
    """The date of a text that is an ISO date or instant (its own date, whatever the offset), else null; dates and timestamps by their day."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    part = lambda i: F.regexp_extract(c, ISO_DATE, i)
    return F.concat_ws("-", part(1), part(3), part(4)).try_cast("date")
