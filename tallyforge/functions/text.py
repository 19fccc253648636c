"""Text expressions: amounts, slugs, names, numeric claims and statement fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY

#: A word's edge and space in ASCII, as RE2 has them; Java's edge asks for letters of any script, its space takes U+000B.
EDGE = r"(?:(?=[0-9A-Za-z_])(?<![0-9A-Za-z_])|(?![0-9A-Za-z_])(?<=[0-9A-Za-z_]))"
SPACE = r"[\t\n\f\r ]"


def ascii_classes(pattern: str) -> str:
    """A pattern whose ``\\b`` and ``\\s`` go by ASCII alone, in Java as in SQL; an edge that begins it before a letter or digit looks back only."""
    opened = re.sub(r"(^|^\(\?i\)|\|)\\b(?=(?:\(\?:)?(0|\\d|\[A-[^\]]+\]))", lambda m: f"{m[1]}(?={m[2]})(?<![0-9A-Za-z_])", pattern)
    return opened.replace(r"\b", EDGE).replace(r"\s", SPACE)


#: Fixed value: currency amounts and percentages in prose.
MONEY_TOKEN = r"[£$]-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\b\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?%"
#: A number within such a token, and amounts with cents.
NUMBER = r"-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?"
CENTS = r"\b\d[\d,]*\.\d{2}\b"
#: What stands before each field of a card statement, and how a due date is written.
BALANCE_KEYS = [r"outstanding\s+balance", r"current\s+balance", r"new\s+balance", r"balance\s+to\s+pay", r"closing\s+balance"]
RATE_KEYS = [r"annual\s+percentage\s+rate", r"\bAPR\b", r"effective\s+rate", r"interest\s+rate"]
PAYMENT_KEYS = [r"minimum\s+payment", r"min(?:imum)?\s+amount\s+due"]
DUE_KEYS = [r"payment\s+due\s+date", r"due\s+by", r"pay\s+by"]
DUE_DATE = r"(\d{1,2}[\s/\-](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s/\-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"


def amount(c: str | Column) -> Column:
    """Money of a text such as ``£1,234.50``; parentheses negate; null where it isn't an amount."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.trim(c), "[£$,]", "")
    value = F.regexp_replace(bare, r"[()]", "").try_cast(MONEY)
    return F.when(bare.rlike(r"^\(.*\)$"), -value).otherwise(value).cast(MONEY)


def slug(c: str | Column, default: str = "merchant") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit(default))


def canonical_name(c: str | Column) -> Column:
    """At most two alphabetic words in title case, one where four or more words came; ``Other`` of none."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)
    clean = F.filter(words, lambda w: w.rlike(r"^\p{L}{2,}$") & ~F.upper(w).isin("USD", "GBP", "EUR"))
    take = F.when(F.size(words) >= 4, 1).otherwise(2)
    return F.when(F.size(clean) == 0, "Other").otherwise(F.initcap(F.array_join(F.slice(clean, 1, take), " ")))


def merchant_id(c: str | Column) -> Column:
    """Slug of the canonical name, its first part where it is longer than 24."""
    s = slug(canonical_name(c))
    return F.when(F.length(s) <= 24, s).otherwise(F.substring_index(s, "_", 1))


def first_json(c: str | Column) -> Column:
    """The first fenced object, else the first ``{...}``; null without one."""
    c = F.col(c) if isinstance(c, str) else c
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)\{.*?\}", 0), F.lit("")))


def json_list(c: str | Column) -> Column:
    """A JSON array of strings; null and what isn't an array are empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def currency_values(c: str | Column) -> Column:
    """Distinct ``int.dd`` values of a text, commas dropped, in order of appearance."""
    found = F.regexp_extract_all(c, F.lit(ascii_classes(CENTS)), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def money_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ascii_classes(MONEY_TOKEN)), F.lit(0))


def token_forms(t: Column) -> Column:
    """Ways in which one value may be written."""
    number = F.regexp_extract(t, NUMBER, 0)
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return F.filter(F.array_distinct(F.array(t, F.regexp_replace(t, "^[£$]+", ""), bare(t), number, bare(number))), lambda x: F.length(x) > 0)


def unsupported_numbers(memos: DataFrame) -> DataFrame:
    """Numbers of ``body`` that no entry of ``cited`` supports, in order, with the text around their first place.

    One row per finding: (id, position, token, excerpt). ``memos`` needs id, body and cited (array of text).
    """
    blessed = F.flatten(F.transform(F.coalesce("cited", F.array().cast("array<string>")), token_forms))
    tokens = memos.select("id", "body", blessed.alias("_b"), F.posexplode(money_tokens("body")).alias("position", "token"))
    found = tokens.where(~F.arrays_overlap(token_forms(F.col("token")), F.col("_b")))
    at = F.expr("instr(body, token)")
    start = F.greatest(at - 25, F.lit(1))
    return found.select("id", "position", "token", F.trim(F.substring(F.col("body"), start, at - start + F.length("token") + 25)).alias("excerpt"))


def _near(text: Column, keys: list[str], value: str, group: int = 1) -> Column:
    """The first key's value within 80 characters of it on its line."""
    options = [F.nullif(F.regexp_extract(text, rf"(?i)(?:{k})[^\n]{{0,80}}?{value}", group), F.lit("")) for k in keys]
    return F.coalesce(*options)


def credit_fields(md: str | Column) -> Column:
    """Struct of outstanding_balance, apr (a fraction), min_payment and payment_due_date (as written)."""
    md = F.col(md) if isinstance(md, str) else md
    money = r"£?\s*([\d,]+(?:\.\d{1,2})?)"
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(12,2)")
    balance = _near(md, BALANCE_KEYS, money)
    rate = _near(md, RATE_KEYS, r"(\d{1,2}(?:\.\d{1,2})?)\s*%")
    least = _near(md, PAYMENT_KEYS, money)
    due = _near(md, DUE_KEYS, DUE_DATE)
    return F.struct(number(balance).alias("outstanding_balance"), F.bround(rate.try_cast("decimal(8,4)") / 100, 4).cast("decimal(6,4)").alias("apr"), number(least).alias("min_payment"), F.trim(due).alias("payment_due_date"))


def snake(c: str | Column) -> Column:
    """CamelCase to snake_case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def decision_id(ts: Column, action: Column, actor: Column) -> Column:
    """``dec_<18 digits and letters of the time>_<action>_<actor>``."""
    return F.concat_ws("_", F.lit("dec"), F.left(F.regexp_replace(ts, "[^0-9A-Za-z]", ""), F.lit(18)), action, actor)
