"""Exact money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def total(c: str | Column) -> Column:
    return F.sum(c).cast(MONEY)


def spend(c: str | Column) -> Column:
    """Sum of absolute amounts: refunds and income count as well."""
    return F.sum(F.abs(c)).cast(MONEY)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double to 6 places; null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def cents(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY).__mul__(100).cast("long")


def mean_cents(c: str | Column) -> Column:
    """Mean of non-negative amounts, halves up, by whole cents."""
    whole, n = F.sum(cents(c)), F.count(c)
    return (F.floor((whole * 2 + n) / (n * 2)) / 100).cast(MONEY)
