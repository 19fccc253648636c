"""The ledger as linked Markdown pages, one kind for each sort of entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.memo import multimap

#: Kinds of pages, by their folders.
KINDS = ("accounts", "categories", "statements", "merchants", "subscriptions")


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))


def head(kind: str, **fields: str | Column) -> Column:
    """A page's head: its type, then ``key: value`` lines in the order given; lists in brackets, null as ``null``."""
    lines = [F.lit(f"type: {kind}"), *(F.concat(F.lit(f"{k}: "), _text(c)) for k, c in fields.items())]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def links(members: str | Column, prefix: str = "") -> Column:
    """A line ``- [[prefix + member]]`` for each member; nothing for none."""
    members = F.coalesce(F.col(members) if isinstance(members, str) else members, F.array().cast("array<string>"))
    return F.array_join(F.transform(members, lambda m: F.concat(F.lit(f"- [[{prefix}"), m, F.lit("]]"))), "\n")


def _page(folder: str, page_id: Column, *parts: Column) -> list[Column]:
    return [F.concat(F.lit(f"{folder}/"), page_id, F.lit(".md")).alias("name"), F.concat(*parts, F.lit("\n")).alias("content")]


def account_pages(accounts: DataFrame, statements: DataFrame) -> DataFrame:
    """Accounts (id, name, type, currency, holder) with links to their statements (id, account_id)."""
    held = multimap(statements, "account_id", "id").withColumnRenamed("account_id", "_a")
    top = head("Account", id="id", name="name", account_type="type", currency="currency", holder="holder")
    body = F.concat(F.lit("# Account `"), "id", F.lit("`\n\n- Type: "), _text("type"), F.lit("\n- Currency: "), _text("currency"), F.lit("\n- Holder: "), F.coalesce(F.nullif("holder", F.lit("")), F.lit("(unset)")), F.lit("\n\n## Statements\n"), links("values"))
    return accounts.join(held, F.col("id") == F.col("_a"), "left").select(*_page("accounts", F.col("id"), top, body))


def category_pages(categories: DataFrame, merchants: DataFrame) -> DataFrame:
    """Categories (id, name) with links to their merchants (id, category_id)."""
    held = multimap(merchants, "category_id", "id").withColumnRenamed("category_id", "_c")
    name = F.concat(F.lit("cat_"), "name")
    body = F.concat(F.lit("# Category: "), "name", F.lit("\n\n## Merchants in this category\n"), links("values", "merchant_"))
    return categories.join(held, F.col("id") == F.col("_c"), "left").select(*_page("categories", name, head("Category", id=name, name="name"), body))


def statement_pages(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """Statements (id, account_id, period_start, period_end, sha256) with links to the merchants of their transactions (statement_id, merchant_id).

    Statements that have these as ``merchants``, sorted, are not joined with transactions.
    """
    if "merchants" in statements.columns:
        linked = statements.withColumnRenamed("merchants", "values")
    else:
        held = multimap(transactions.select("statement_id", "merchant_id"), "statement_id", "merchant_id")
        linked = statements.join(held, F.col("id") == F.col("statement_id"), "left")
    top = head("Statement", id="id", account_id="account_id", period_start="period_start", period_end="period_end", sha256="sha256")
    body = F.concat(F.lit("# Statement "), "id", F.lit("\n\n- Account: [["), "account_id", F.lit("]]\n- Period: "), _text("period_start"), F.lit(" → "), _text("period_end"), F.lit("\n- SHA-256: `"), _text("sha256"), F.lit("`\n\n## Merchants seen this period\n"), links("values", "merchant_"))
    return linked.select(*_page("statements", F.col("id"), top, body))


def merchant_pages(merchants: DataFrame, categories: DataFrame, transactions: DataFrame) -> DataFrame:
    """Merchants (id, canonical_name, category_id, aliases) with links to their category and the statements that saw them."""
    held = multimap(transactions.select("merchant_id", "statement_id"), "merchant_id", "statement_id")
    named = merchants.join(categories.select(F.col("id").alias("_c"), F.col("name").alias("_category")), F.col("category_id") == F.col("_c"), "left").join(held, F.col("id") == F.col("merchant_id"), "left")
    page, category = F.concat(F.lit("merchant_"), "id"), F.coalesce("_category", F.lit("other"))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    top = head("Merchant", id=page, canonical_name="canonical_name", category=category, aliases=F.to_json(aliases))
    body = F.concat(F.lit("# "), _text("canonical_name"), F.lit("\n\n- Category: [[cat_"), category, F.lit("]]\n- Aliases: "), F.coalesce(F.nullif(F.array_join(aliases, ", "), F.lit("")), F.lit("(none)")), F.lit("\n\n## Statements where seen\n"), links("values"))
    return named.select(*_page("merchants", page, top, body))


def subscription_pages(patterns: DataFrame) -> DataFrame:
    """Patterns (id, merchant_id, cadence, expected_amount, last_seen, confidence)."""
    page = F.concat(F.lit("sub_"), "id")
    amount, sure = F.col("expected_amount").cast("decimal(18,2)"), F.round(F.col("confidence").cast("double"), 2).cast("decimal(4,2)")
    top = head("Subscription", id=page, merchant_id="merchant_id", cadence="cadence", expected_amount=amount, last_seen="last_seen", confidence=sure)
    body = F.concat(F.lit("# Subscription `"), "id", F.lit("`\n\n- Merchant: [[merchant_"), "merchant_id", F.lit("]]\n- Cadence: "), _text("cadence"), F.lit(" @ £"), _text(amount), F.lit("\n- Last seen: "), _text("last_seen"), F.lit("\n- Confidence: "), _text(sure))
    return patterns.select(*_page("subscriptions", page, top, body))


def all_pages(accounts: DataFrame, statements: DataFrame, categories: DataFrame, merchants: DataFrame, patterns: DataFrame, transactions: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(name, content) of the kinds asked for, all five by default; of the others nothing is computed."""
    made = {
        "accounts": lambda: account_pages(accounts, statements),
        "categories": lambda: category_pages(categories, merchants),
        "statements": lambda: statement_pages(statements, transactions),
        "merchants": lambda: merchant_pages(merchants, categories, transactions),
        "subscriptions": lambda: subscription_pages(patterns),
    }
    return reduce(DataFrame.unionByName, (made[k]() for k in kinds))
