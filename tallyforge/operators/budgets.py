"""Budgets against actual spend, and progress towards goals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import periods
from tallyforge.functions.money import MONEY, spend, total


def _zero():
    return F.lit(0).cast(MONEY)


def actuals(transactions: DataFrame, categories: DataFrame, period: str) -> DataFrame:
    """(scope_type, scope_id, actual): spend of the month by category name and by merchant id."""
    month = transactions.where(periods.inside("date", period))
    by_category = month.groupBy("category_id").agg(spend("amount").alias("actual")).join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    by_merchant = month.where("merchant_id is not null").groupBy("merchant_id").agg(spend("amount").alias("actual"))
    one = by_category.select(F.lit("category").alias("scope_type"), F.col("name").alias("scope_id"), "actual")
    return one.unionByName(by_merchant.select(F.lit("merchant").alias("scope_type"), F.col("merchant_id").alias("scope_id"), "actual"))


def budget_variance(budgets: DataFrame, spent: DataFrame, period: str, tolerance: float = 0.05) -> DataFrame:
    """Each budget of the month, and a twelfth of each of the year, against what was spent."""
    year = f"annual:{periods.split(period)[0]}"
    monthly = F.when(F.col("period") == year, F.bround(F.col("target_amount") / 12, 2)).otherwise(F.col("target_amount")).cast(MONEY)
    mine = budgets.where(F.col("period").isin(period, year)).withColumn("target", monthly)
    joined = mine.join(spent, ["scope_type", "scope_id"], "left").withColumn("actual", F.coalesce("actual", _zero()))
    delta = (F.col("actual") - F.col("target")).cast(MONEY)
    pct = F.when(F.col("target") != 0, F.round(delta.cast("double") / F.col("target").cast("double"), 6)).when(delta != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    out = joined.withColumn("delta", delta).withColumn("delta_pct", pct)
    status = F.when(F.abs("delta_pct") <= tolerance, "on_track").when(F.col("delta_pct") > 0, "over").otherwise("under")
    return out.select("id", "scope_type", "scope_id", "target", "actual", "delta", "delta_pct", status.alias("status"))


def with_variance(budgets: DataFrame, variances: DataFrame) -> DataFrame:
    """All budgets, those of other months without actual, delta, delta_pct and status."""
    return budgets.join(variances.select("id", "actual", "delta", "delta_pct", "status"), "id", "left")


def goal_progress(goals: DataFrame, transactions: DataFrame, period: str, tolerance: float = 0.05) -> DataFrame:
    """All goals at a month's end in one job: each sums its own scope over its own span.

    ``savings_account`` goals add up signed amounts of an account, at least 0;
    ``category_underspend`` goals are caps, whose progress is what is left of them; others have
    none. A goal without a start begins at the month's end. ``transactions`` needs
    account_id, category (a name), date and amount.
    """
    end = F.lit(periods.window(period)[1])
    begun = goals.withColumn("_from", F.coalesce("started_at", end))
    account = transactions.select(F.lit("savings_account").alias("scope_type"), F.col("account_id").alias("scope_id"), "date", "amount")
    category = transactions.select(F.lit("category_underspend").alias("scope_type"), F.col("category").alias("scope_id"), "date", "amount")
    sums = begun.select("id", "scope_type", "scope_id", "_from").join(account.unionByName(category), ["scope_type", "scope_id"]).where(F.col("date").between(F.col("_from"), end))
    sums = sums.groupBy("id").agg(total("amount").alias("_net"), spend("amount").alias("_spent"))
    target = F.col("target_amount").cast(MONEY)
    net, spent = F.coalesce("_net", _zero()), F.coalesce("_spent", _zero())
    current = F.when(F.col("scope_type") == "savings_account", F.greatest(net, _zero())).when(F.col("scope_type") == "category_underspend", F.greatest(target - spent, _zero())).otherwise(_zero())
    months = lambda until: F.when(until < F.col("_from"), 0).otherwise(periods.months_inclusive(F.col("_from"), until))
    out = begun.join(sums, "id", "left").select("*", current.cast(MONEY).alias("current"), months(F.col("target_date")).alias("months_total"))
    out = out.withColumn("months_elapsed", F.least(months(end), F.col("months_total")))
    left = F.col("months_total") - F.col("months_elapsed")
    pct = F.when(target > 0, F.round(F.col("current").cast("double") / target.cast("double"), 6)).otherwise(F.lit(0.0))
    due = F.when(F.col("months_total") > 0, F.round(F.col("months_elapsed") / F.col("months_total"), 6)).otherwise(F.lit(1.0))
    need = F.when(left > 0, F.bround((target - F.col("current")) / F.greatest(left, F.lit(1)), 2)).otherwise(_zero())
    out = out.select("*", pct.alias("pct"), due.alias("expected_pct"), need.cast(MONEY).alias("monthly_required"))
    gap = F.round(F.col("pct") - F.col("expected_pct"), 6)
    progress = (
        F.when(F.col("status").isin("achieved", "missed"), F.col("status"))
        .when(F.col("current") >= target, "achieved")
        .when(left <= 0, "missed")
        .when(F.abs(gap) <= tolerance, "on_track")
        .when(gap > 0, "ahead")
        .otherwise("behind")
    )
    return out.select("id", "scope_type", "scope_id", target.alias("target"), "current", "months_total", "months_elapsed", "pct", "expected_pct", "monthly_required", progress.alias("progress"))


def active_goal_progress(goals: DataFrame, transactions: DataFrame, period: str, tolerance: float = 0.05) -> DataFrame:
    return goal_progress(goals.where("status = 'active'"), transactions, period, tolerance)
