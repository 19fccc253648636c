"""Loan schedules by exact integers of cents, a batch of loans a month at a time."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions.money import MONEY, cents

MAX_MONTHS = 600
#: Rows of schedules that a task gathers before it hands them on.
ROWS = 65_536
#: A rate's units in one, and the cents up to which a balance times half a rate fits 64 bits.
UNIT, NARROW = 10**16, 9 * 10**9
_TERMS = ["_left", "_rate", "_pay"]


def _product(left: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole cents of ``left * rate`` and the rest in units: by the rate's halves, or by Python's integers."""
    if left.dtype == object:
        return left * rate // UNIT, left * rate % UNIT
    high, middle = np.divmod(left * (rate // 10**8), 10**8)
    carry, rest = np.divmod(middle * 10**8 + left * (rate % 10**8), UNIT)
    return high + carry, rest


def _months(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(month, places of the loans that pay in it, interest, principal, balance) until all are paid off.

    Interest is rounded half-even to cents each month; the last month pays what is left. Loans whose balance never falls have no month.
    """
    left, rate, pay = (batch.column(c).to_numpy(zero_copy_only=False) for c in _TERMS)
    if len(left) and left.max() > NARROW:
        left, rate, pay = (x.astype(object) for x in (left, rate, pay))
    at = np.flatnonzero((left > 1) & (pay > 0) & (_product(left, rate)[0] < pay))
    for month in range(1, MAX_MONTHS + 1):
        left, rate, pay = left[at], rate[at], pay[at]
        if not len(left):
            return
        places = at if month == 1 else places[at]
        whole, rest = _product(left, rate)
        interest = whole + ((rest * 2 > UNIT) | ((rest * 2 == UNIT) & (whole % 2 == 1)))
        principal = np.minimum(pay - interest, left)
        left = left - principal
        yield month, places, interest, principal, left
        at = np.flatnonzero(left > 1)


def _terms(loans: DataFrame) -> DataFrame:
    """Loans with balance, monthly rate and payment as integers, 0 where one is unknown, dealt to as many tasks as a shuffle has.

    The table of loans is small and may be one file of one row group, while a loan takes up to MAX_MONTHS steps.
    """
    rate = F.col("apr").cast("decimal(22,18)") / 12
    terms = [cents("outstanding"), (rate.cast("decimal(17,16)") * F.lit(UNIT)).cast("long"), cents("payment")]
    known = F.col("outstanding").isNotNull() & F.col("apr").isNotNull() & F.col("payment").isNotNull()
    tasks = int(loans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return loans.select("*", *(F.when(known, t).otherwise(F.lit(0)).alias(n) for t, n in zip(terms, _TERMS, strict=True))).repartition(tasks)


def _money(c: str) -> Column:
    return (F.col(c).cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY).alias(c)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def amortisation(loans: DataFrame) -> DataFrame:
    """(id, month, payment, interest, principal, balance) of each loan (id, outstanding, apr, payment), a row a month; none where a term is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[pa.Array]] = []
            n = 0
            for month, places, interest, principal, left in _months(batch):
                held.append([batch.column("id").take(pa.array(places)), pa.array(np.full(len(places), month, np.int32)), *map(_long, (interest + principal, interest, principal, left))])
                n += len(places)
                if n >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], schema.names)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], schema.names)

    schema = StructType([loans.schema["id"]]).add("month", "integer").add("payment", "long").add("interest", "long").add("principal", "long").add("balance", "long")
    rows = _terms(loans).select("id", *_TERMS).mapInArrow(run, schema)
    return rows.select("id", "month", *map(_money, ("payment", "interest", "principal", "balance")))


def payoff(loans: DataFrame, *keep: str) -> DataFrame:
    """(id, months, total_interest) and columns to ``keep``: months is -1 where the loan is never paid off, already is, or lacks a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            months = np.full(batch.num_rows, -1, np.int32)
            total = np.zeros(batch.num_rows, np.int64)
            for month, places, interest, _, _ in _months(batch):
                months[places] = month
                total[places] += interest.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(months), _long(total)], [*names, "months", "total_interest"])

    names = ["id", *keep]
    schema = StructType([loans.schema[c] for c in names]).add("months", "integer").add("total_interest", "long")
    rows = _terms(loans).select(*names, *_TERMS).mapInArrow(run, schema)
    return rows.select("id", "months", _money("total_interest"), *keep)


def recommended_payment(outstanding: Column, apr: Column, months: Column) -> Column:
    """The level payment that clears the loan in ``months``; months below 1 raise."""
    rate = apr.cast("double") / 12
    owed = outstanding.cast("double")
    level = F.when(rate == 0, owed / months).otherwise(F.try_divide(owed * rate, 1 - F.pow(1 + rate, -months)))
    return F.when(months > 0, F.bround(level, 2).cast(MONEY)).otherwise(F.raise_error(F.lit("months must be positive")).cast(MONEY))
