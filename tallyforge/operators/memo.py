"""The monthly memo, rendered by expressions from the month's rollups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import periods


def _section(rank: int, title: str, rows: DataFrame, order: str, line) -> DataFrame:
    """One row: the section's heading and its lines in order, ``_None._`` without any."""
    held = rows.select(F.struct(F.col(order).alias("k"), line.alias("v")).alias("s")).agg(F.sort_array(F.collect_list("s"), asc=False).alias("l"))
    body = F.coalesce(F.nullif(F.array_join(F.transform("l", lambda s: F.concat(F.lit("- "), s["v"])), "\n"), F.lit("")), F.lit("_None._"))
    return held.select(F.lit(rank).alias("rank"), F.concat(F.lit(f"## {title}\n\n"), body).alias("text"))


def render(period: str, categories: DataFrame, merchants: DataFrame, variances: DataFrame, goals: DataFrame, outliers: DataFrame, forecasts: DataFrame, net_worth: DataFrame) -> DataFrame:
    """(period, body_md): sections for what was spent where, budgets, goals, anomalies, outlook and net worth."""
    f = lambda form, *c: F.format_string(form, *(F.col(x).cast("string") for x in c))
    parts = [
        _section(1, "Top Categories", categories, "total", f("%s: £%s in %s", "category", "total", "txn_count")),
        _section(2, "Top Merchants", merchants, "total", f("[[%s]]: £%s in %s", "merchant_id", "total", "txn_count")),
        _section(3, "Budgets", variances, "id", f("%s: £%s of £%s, %s", "id", "actual", "target", "status")),
        _section(4, "Goals", goals, "id", f("%s: £%s of £%s, %s", "id", "current", "target", "progress")),
        _section(5, "Anomalies", outliers, "this_total", f("[[%s]]: £%s against a mean of £%s", "merchant_id", "this_total", "mean")),
        _section(6, "Outlook", forecasts, "category", F.concat_ws(" ", F.concat("category", F.lit(":")), F.array_join(F.transform("forecast", lambda x: F.concat(F.lit("£"), F.format_number(x, 2))), ", "), F.concat(F.lit("("), "method", F.lit(")")))),
        _section(7, "Net Worth", net_worth, "period", f("%s: £%s", "period", "total_amount")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    y, m = periods.split(period)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n\n")
    return every.agg(F.lit(period).alias("period"), F.concat(F.lit(f"# Memo {y}-{m:02d}\n\n"), text).alias("body_md"))


def missing_periods(memos: DataFrame, first: str, last: str) -> DataFrame:
    """Months from first to last that have no memo yet."""
    months = memos.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, periods.between(first, last)))).alias("period"))
    return months.join(memos.select("period").distinct(), "period", "left_anti")


def backfill(memos: DataFrame, first: str, last: str, render_month: Callable[[str], DataFrame]) -> DataFrame | None:
    """The memos (period, body_md) of the months from first to last that have none, None if all have one."""
    months = [r.period for r in missing_periods(memos, first, last).orderBy("period").collect()]
    return reduce(DataFrame.unionByName, map(render_month, months)) if months else None


def multimap(links: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the distinct values of each key, sorted."""
    return links.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def entity_pages(entities: DataFrame, links: DataFrame, title: str) -> DataFrame:
    """(name, content): a Markdown page for each entity (id, title) with links to its members (id, member)."""
    held = multimap(links, "id", "member")
    body = F.array_join(F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.concat(F.lit("- [["), v, F.lit("]]"))), "\n")
    head = F.concat(F.lit("---\nid: "), "id", F.lit(f"\ntype: {title}\n---\n# "), "title", F.lit("\n\n"))
    return entities.join(held, "id", "left").select(F.concat("id", F.lit(".md")).alias("name"), F.concat(head, body, F.lit("\n")).alias("content"))
