"""Subscription drift, spend outliers and recurring payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import periods
from tallyforge.functions.money import MONEY, mean_cents
from tallyforge.operators.spending import merchant_months

#: z of a merchant whose history doesn't vary at all, but whose month differs.
FLAT_HISTORY_Z = 999.0


def subscription_drift(transactions: DataFrame, patterns: DataFrame, period: str, tolerance: float = 0.05) -> DataFrame:
    """Charges that differ from what their pattern expects by more than ``tolerance``; patterns of 0 are left out."""
    expected = patterns.where("expected_amount <> 0").select(F.col("id").alias("pattern_id"), F.col("merchant_id").alias("_m"), "expected_amount")
    charges = transactions.where(periods.inside("date", period)).join(expected, "pattern_id")
    delta = F.abs(F.abs("amount").cast("double") - F.col("expected_amount").cast("double")) / F.col("expected_amount").cast("double")
    found = charges.select(F.col("id").alias("transaction_id"), F.col("_m").alias("merchant_id"), "amount", "expected_amount", F.round(delta, 6).alias("delta_pct"))
    return found.where(F.col("delta_pct") > tolerance)


def merchant_outliers(transactions: DataFrame, period: str, lookback: int = 6, z: float = 2.0) -> DataFrame:
    """Merchants whose month is ``z`` population deviations or more from their last active months before it.

    History is the ``lookback`` latest active months, two at least. Without deviation, any
    other value has FLAT_HISTORY_Z.
    """
    target = period.replace("-", "_")
    months = merchant_months(transactions.where(F.col("date") <= F.lit(periods.window(period)[1])))
    latest = Window.partitionBy("merchant_id").orderBy(F.desc("period"))
    past = months.where(F.col("period") < target).withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= lookback)
    amount = F.col("total").cast("double")
    history = past.groupBy("merchant_id").agg(F.avg(amount).alias("mean"), F.stddev_pop(amount).alias("sd"), F.count(F.lit(1)).alias("months")).where("months >= 2")
    both = months.where(F.col("period") == target).select("merchant_id", F.col("total").alias("this_total")).join(history, "merchant_id")
    gap = F.col("this_total").cast("double") - F.col("mean")
    flat = F.round("sd", 6) == 0
    score = F.when(flat & (F.round(gap, 6) != 0), F.lit(FLAT_HISTORY_Z)).when(flat, F.lit(0.0)).otherwise(F.try_divide(gap, F.col("sd")))
    out = both.withColumn("z_score", F.round(score, 6)).where(F.abs("z_score") >= z)
    return out.select("merchant_id", "this_total", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "months", "z_score")


def recurring(transactions: DataFrame, min_months: int = 3, max_cv: float = 0.05) -> DataFrame:
    """Merchants charged in ``min_months`` months or more with a coefficient of variation up to ``max_cv``."""
    spent = F.abs("amount").cast("double")
    stats = transactions.where(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        mean_cents(F.abs("amount")).alias("expected_amount"),
        F.countDistinct(F.trunc("date", "MM")).alias("months"),
        F.max("date").alias("last_seen"),
        F.avg(spent).alias("_mean"),
        F.stddev_samp(spent).alias("_sd"),
    )
    steady = F.col("_sd").isNull() | (F.col("_mean") == 0) | (F.try_divide(F.col("_sd"), F.col("_mean")) <= max_cv)
    confidence = F.round(F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * F.col("months")), 6)
    return stats.where((F.col("months") >= min_months) & steady).select("merchant_id", F.lit("monthly").alias("cadence"), "expected_amount", "months", "last_seen", confidence.alias("confidence"))


def within_band(amount: Column, expected: Column, tolerance: float) -> Column:
    return F.abs(F.abs(amount) - expected) <= (F.lit(tolerance).cast("decimal(6,4)") * expected)


def link_patterns(transactions: DataFrame, patterns: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Transactions with ``pattern_id`` set where the merchant's pattern expects about that amount; older links give way."""
    wanted = patterns.groupBy("merchant_id").agg(F.min(F.struct("id", "expected_amount")).alias("_p"))
    joined = transactions.join(wanted, "merchant_id", "left")
    fits = F.col("_p").isNotNull() & within_band(F.col("amount"), F.col("_p.expected_amount"), tolerance)
    old = F.col("pattern_id") if "pattern_id" in transactions.columns else F.lit(None).cast("string")
    return joined.withColumn("pattern_id", F.when(fits, F.col("_p.id")).otherwise(old)).drop("_p")


def derive_patterns(transactions: DataFrame, first: str, last: str) -> DataFrame:
    """One pattern per merchant: its mean charge between two months."""
    span = F.col("date").between(F.lit(periods.window(first)[0]), F.lit(periods.window(last)[1]))
    mean = transactions.where(span & F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(mean_cents(F.abs("amount")).cast(MONEY).alias("expected_amount"), F.max("date").alias("last_seen"))
    return mean.select(F.concat(F.lit("p_"), "merchant_id").alias("id"), "merchant_id", "expected_amount", "last_seen")
