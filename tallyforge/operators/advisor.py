"""Recommendations drawn from anomalies, budgets, goals, debts, forecasts and net worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.money import MONEY
from tallyforge.operators import debt, net_worth

#: Names that say nothing about a merchant.
GENERIC_NAMES = ["Other", "Unknown", "Name", "Direct Debit", "X"]


def _draft(rows: DataFrame, kind: str, body: Column, citations: list[Column], cited: list[Column], confidence: float) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), body.alias("body_md"), F.array(*citations).alias("citations"), F.array(*(c.cast("string") for c in cited)).alias("cited_values"), F.lit(confidence).alias("confidence"))


def _text(form: str, *parts: Column) -> Column:
    return F.format_string(form, *(p.cast("string") for p in parts))


def subscription_cancel(drift: DataFrame, period: str, at_least: float = 0.5) -> DataFrame:
    c = F.col
    body = _text(f"## Review subscription [[%s]]\n\nIn {period} it charged £%s where £%s was expected.", c("merchant_id"), c("amount"), c("expected_amount"))
    return _draft(drift.where(c("delta_pct") >= at_least), "subscription_cancel", body, [c("merchant_id")], [c("amount"), c("expected_amount"), c("delta_pct")], 0.7)


def budget_adjust(variances: DataFrame, period: str, at_least: float = 0.2) -> DataFrame:
    c = F.col
    body = _text(f"## Reconsider budget [[%s]]\n\nIn {period} spend was £%s against a target of £%s.", c("id"), c("actual"), c("target"))
    return _draft(variances.where((c("status") == "over") & (c("delta_pct") >= at_least)), "budget_adjust", body, [c("id")], [c("actual"), c("target"), c("delta_pct")], 0.65)


def goal_off_track(goals: DataFrame) -> DataFrame:
    c = F.col
    left = F.greatest(c("months_total") - c("months_elapsed"), F.lit(1))
    body = _text("## Behind on goal [[%s]]\n\nAfter %s of %s months it stands at £%s of £%s. £%s a month would be needed for %s more.", c("id"), c("months_elapsed"), c("months_total"), c("current"), c("target"), c("monthly_required"), left)
    return _draft(goals.where(c("progress").isin("behind", "missed")), "goal_off_track", body, [c("id")], [c("current"), c("target"), c("monthly_required"), c("months_elapsed"), c("months_total"), left], 0.7)


def anomaly_investigate(outliers: DataFrame, period: str, at_least: float = 3.0) -> DataFrame:
    c = F.col
    body = _text(f"## Look into [[%s]]\n\nIn {period} it took £%s, %s deviations from its mean of £%s.", c("merchant_id"), c("this_total"), c("z_score"), c("mean"))
    return _draft(outliers.where(F.abs("z_score") >= at_least), "anomaly_investigate", body, [c("merchant_id")], [c("this_total"), c("mean"), c("z_score")], 0.6)


def credit_payoff_accelerate(statements: DataFrame, min_apr: float = 0.1, min_months: int = 24) -> DataFrame:
    """Cards (id, account_id, outstanding, apr, min_payment) whose minimum payment takes two years or more; half the time is proposed."""
    c = F.col
    known = statements.where((c("outstanding") > 0) & (c("apr") >= min_apr) & (c("min_payment") > 0))
    kept = ["account_id", "outstanding", "apr", "min_payment"]
    slow = debt.payoff(known.withColumn("payment", c("min_payment")), *kept).where(c("months") >= min_months)
    half = slow.withColumn("target_months", F.greatest(F.floor(c("months") / 2).cast("int"), F.lit(12))).withColumnsRenamed({"months": "_months", "total_interest": "_interest"})
    half = half.withColumn("suggested", debt.recommended_payment(c("outstanding"), c("apr"), c("target_months")))
    faster = debt.payoff(half.withColumn("payment", c("suggested")), *kept, "_months", "_interest", "target_months", "suggested").select("*", c("total_interest").alias("interest_then"))
    both = faster.drop("months", "total_interest").withColumnsRenamed({"_months": "months", "_interest": "total_interest"})
    body = _text("## Pay [[%s]] down faster\n\n£%s at the minimum of £%s takes %s months and £%s of interest; £%s a month takes %s and £%s.", c("account_id"), c("outstanding"), c("min_payment"), c("months"), c("total_interest"), c("suggested"), c("target_months"), c("interest_then"))
    return _draft(both, "credit_payoff_accelerate", body, [c("account_id"), c("id")], [c("outstanding"), c("min_payment"), c("suggested"), c("total_interest"), c("interest_then"), c("months"), c("target_months")], 0.7)


def forecast_overshoot(forecasts: DataFrame, variances: DataFrame, over: float = 0.1) -> DataFrame:
    """Categories whose spend so far and three forecast months exceed the budget by a tenth."""
    c = F.col
    budget = variances.where(c("scope_type") == "category").select("id", c("scope_id").alias("category"), "target", "actual")
    ahead = F.aggregate("forecast", F.lit(0).cast(MONEY), lambda s, x: (s + F.bround(x, 2).cast(MONEY)).cast(MONEY))
    both = forecasts.join(budget, "category").withColumn("projected", (c("actual") + ahead).cast(MONEY)).where((c("target") > 0))
    both = both.withColumn("overshoot", (c("projected") - c("target")).cast(MONEY)).where(c("overshoot").cast("double") > c("target").cast("double") * over)
    cap = F.bround((c("target") - c("actual")) / 3, 2).cast(MONEY)
    body = _text("## [[%s]] is heading over\n\nSpend on %s is projected at £%s against £%s, £%s too much. A cap of £%s a month would hold it.", c("id"), c("category"), c("projected"), c("target"), c("overshoot"), cap)
    return _draft(both, "forecast_overshoot", body, [c("id")], [c("projected"), c("target"), c("overshoot"), cap], 0.6)


def net_worth_decline(snapshots: DataFrame, period: str) -> DataFrame:
    """When the latest three snapshots up to ``period`` fell twice."""
    c = F.col
    row = net_worth.latest(snapshots, period).agg(F.sort_array(F.collect_list(F.struct("period", "total_amount")), asc=False).alias("h")).where(F.size("h") == 3)
    now, one, two = (c("h")[i]["total_amount"] for i in range(3))
    body = _text("## Net worth fell twice\n\nIn %s it was £%s, after £%s and £%s.", c("h")[0]["period"], now, one, two)
    cite = [F.concat(F.lit("snap_"), c("h")[i]["period"]) for i in range(3)]
    return _draft(row.where((now < one) & (one < two)), "net_worth_decline", body, cite, [now, one, two], 0.55)


def recommendations(parts: list[DataFrame], period: str) -> DataFrame:
    """All drafts with ids that depend on their text alone."""
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("id", F.concat(F.lit(f"rec_{period}_"), F.left(F.sha2("body_md", 256), F.lit(8))))


def flag_generic(merchants: DataFrame) -> DataFrame:
    """Merchants whose name says nothing, with a stable concept id."""
    reason = F.lit("generic merchant name")
    found = merchants.where(F.col("canonical_name").isin(GENERIC_NAMES))
    return found.select("id", "canonical_name", F.concat(F.lit("concept_"), "id", F.lit("_"), F.left(F.sha2(F.concat_ws("|", "id", F.lit("merchant"), reason), 256), F.lit(8))).alias("concept_id"))


def latest_statement(statements: DataFrame, until) -> DataFrame:
    """Each account's last statement that ends by a date; the larger id wins a tie."""
    w = Window.partitionBy("account_id").orderBy(F.desc("period_end"), F.desc("id"))
    return statements.where(F.col("period_end") <= F.lit(until)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
