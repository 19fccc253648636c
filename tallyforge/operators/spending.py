"""Period rollups of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import periods
from tallyforge.functions.money import spend, total


def category_totals(transactions: DataFrame, categories: DataFrame, period: str) -> DataFrame:
    """(category, total, txn_count), largest first. Transactions without a category don't count."""
    rows = transactions.where(periods.inside("date", period)).groupBy("category_id").agg(spend("amount").alias("total"), F.count(F.lit(1)).alias("txn_count"))
    named = rows.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")
    return named.select("category", "total", "txn_count").orderBy(F.desc("total"), "category")


def merchant_totals(transactions: DataFrame, merchants: DataFrame, period: str, top_n: int | None = 10) -> DataFrame:
    """(merchant_id, canonical_name, total, txn_count) of the ``top_n`` merchants, all with None."""
    rows = transactions.where(periods.inside("date", period) & F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(spend("amount").alias("total"), F.count(F.lit(1)).alias("txn_count"))
    named = rows.join(merchants.select(F.col("id").alias("merchant_id"), "canonical_name"), "merchant_id")
    named = named.select("merchant_id", "canonical_name", "total", "txn_count").orderBy(F.desc("total"), "merchant_id")
    return named if top_n is None else named.limit(top_n)


def account_delta(transactions: DataFrame, period: str) -> DataFrame:
    """Signed sum per account; accounts without a transaction are absent."""
    return transactions.where(periods.inside("date", period)).groupBy("account_id").agg(total("amount").alias("delta"))


def category_history(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, period, total) for every month with a transaction."""
    rows = transactions.groupBy("category_id", periods.key("date").alias("period")).agg(spend("amount").alias("total"))
    return rows.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id").select("category", "period", "total")


def merchant_months(transactions: DataFrame) -> DataFrame:
    """(merchant_id, period, total, txn_count) for every active month."""
    known = transactions.where(F.col("merchant_id").isNotNull())
    return known.groupBy("merchant_id", periods.key("date").alias("period")).agg(spend("amount").alias("total"), F.count(F.lit(1)).alias("txn_count"))


def signed_rollup(transactions: DataFrame, *by: str) -> DataFrame:
    """Signed total and count by any of merchant_id, category_id, month and year."""
    made = {"month": periods.key("date").alias("month"), "year": F.year("date").alias("year")}
    return transactions.groupBy(*(made.get(b, b) for b in by)).agg(total("amount").alias("total"), F.count(F.lit(1)).alias("txn_count"))
