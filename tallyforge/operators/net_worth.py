"""Positions per account and net worth over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import periods
from tallyforge.functions.money import MONEY, ratio, total


def positions(transactions: DataFrame, accounts: DataFrame, period: str) -> DataFrame:
    """Every account's sum of amounts up to the month's end, 0 without any."""
    held = transactions.where(F.col("date") <= F.lit(periods.window(period)[1])).groupBy("account_id").agg(total("amount").alias("_sum"))
    return accounts.select(F.col("id").alias("account_id")).join(held, "account_id", "left").select("account_id", F.coalesce("_sum", F.lit(0).cast(MONEY)).alias("position"))


def snapshot(transactions: DataFrame, accounts: DataFrame, period: str) -> DataFrame:
    """(period, account_id, position): what a snapshot holds of each account, one row an account."""
    return positions(transactions, accounts, period).select(F.lit(period).alias("period"), "account_id", "position")


def snapshot_totals(snapshots: DataFrame) -> DataFrame:
    """(period, total_amount, accounts) of snapshots."""
    return snapshots.groupBy("period").agg(total("position").alias("total_amount"), F.count(F.lit(1)).alias("accounts"))


def running_positions(transactions: DataFrame) -> DataFrame:
    """(account_id, period, net, position): each active month's sum and the sum so far."""
    months = transactions.groupBy("account_id", periods.key("date").alias("period")).agg(total("amount").alias("net"))
    so_far = Window.partitionBy("account_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return months.withColumn("position", F.sum("net").over(so_far).cast(MONEY))


def monthly_totals(transactions: DataFrame) -> DataFrame:
    """(period, total_amount): the net worth of all accounts at each active month's end; one row a month."""
    months = transactions.groupBy(periods.key("date").alias("period")).agg(total("amount").alias("_net"))
    return months.select("period", F.sum("_net").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY).alias("total_amount"))


def month_over_month(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(period, total_amount, previous, delta, delta_pct) against the calendar month before; null where it isn't stored or is 0."""
    month = F.to_date(F.concat("period", F.lit("_01")), "yyyy_MM_dd")
    before = stored.select(periods.key(F.add_months(month, 1)).alias("period"), F.col("total_amount").alias("previous"))
    delta = (F.col("total_amount") - F.col("previous")).cast(MONEY)
    return current.select("period", "total_amount").join(before, "period", "left").select("period", "total_amount", "previous", delta.alias("delta"), ratio(delta, F.col("previous")).alias("delta_pct"))


def latest(snapshots: DataFrame, period: str, n: int = 3) -> DataFrame:
    """The last ``n`` snapshots up to ``period``, newest first."""
    return snapshots.where(F.col("period") <= period).select("period", "total_amount").orderBy(F.desc("period")).limit(n)


def lagged(snapshots: DataFrame) -> DataFrame:
    """Change against the snapshot before, whatever its month."""
    before = F.lag("total_amount").over(Window.orderBy("period"))
    return snapshots.select("period", "total_amount", (F.col("total_amount") - before).cast(MONEY).alias("delta"))


def declines(snapshots: DataFrame) -> DataFrame:
    """Snapshots that are the second of two declines in a row."""
    order = Window.orderBy("period")
    one, two = F.lag("total_amount", 1).over(order), F.lag("total_amount", 2).over(order)
    falls = snapshots.select("period", "total_amount", one.alias("_one"), two.alias("_two"))
    return falls.where("total_amount < _one and _one < _two").select("period", "total_amount", (F.col("total_amount") - F.col("_two")).cast(MONEY).alias("fall"))
