"""Masking of personal data by ordered patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.text import ascii_classes
from tallyforge.sources.places import bound_batches, cut

#: The patterns, in the order in which they apply, and what they become.
CARD = r"\b(?:\d{4}[\s-]){3}\d{4}\b|\b\d{4}[\s-]\d{6}[\s-]\d{5}\b"
PATTERNS = [
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "EMAIL"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "IBAN"),
    (r"\+44[\s\-]?\d{2,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}", "PHONE"),
    (r"\b0\d{10}\b", "PHONE"),
    (r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", "POSTCODE"),
    (r"(?i)\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]?\b", "NI_NUMBER"),
    (r"\b\d{2}-\d{2}-\d{2}\b", "SORT_CODE"),
    (r"(?i)\b\d{1,4}[A-Z]?\s+(?:[A-Z][A-Za-z'’]*\s+){1,5}(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Way|Close|Cl|Drive|Dr|Crescent|Cres|Place|Pl|Court|Ct|Square|Sq|Gardens|Gdns|Park|Pk|Hill|Mews|Walk|Terrace|Boulevard|Blvd|Row)\b\.?", "ADDRESS"),
    (r"\b\d{8,}\b", "NUM"),
]
#: Words before a long number that make it an account number, and how far back they count.
ACCOUNT_WORDS, ACCOUNT_SPAN = ("account", "acct", "a/c"), 30


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits with a right check digit; spaces and hyphens don't count."""
    digits = F.regexp_replace(c, r"[\s-]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def mask(c: str | Column, denylist: tuple[str, ...] = ()) -> Column:
    """Personal data as bracketed names. Grouped card numbers go only if their check digit is right. Null is empty."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    cards = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(ascii_classes(CARD)), F.lit(0))), luhn_ok)
    out = F.aggregate(cards, c, lambda s, card: F.replace(s, card, F.lit("[CARD]")))
    for pattern, name in PATTERNS:
        out = F.regexp_replace(out, ascii_classes(pattern), f"[{name}]")
    for name in denylist:
        if name.strip():
            out = F.regexp_replace(out, "(?i)" + re.escape(name.strip()), "[NAME]")
    return out


def residual(c: str | Column) -> Column:
    """Name of the first kind of personal data that is left, else null."""
    c = F.col(c) if isinstance(c, str) else c
    left = F.exists(F.regexp_extract_all(c, F.lit(ascii_classes(CARD)), F.lit(0)), luhn_ok)
    out = F.when(left, "CARD")
    for pattern, name in PATTERNS:
        out = out.when(c.rlike(ascii_classes(pattern)), name)
    return out


def assert_none(c: str | Column) -> Column:
    """The text, or an error naming the personal data in it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(residual(c).isNull(), c).otherwise(F.raise_error(F.concat(F.lit("personal data left: "), residual(c))))


_KINDS = {"NI_NUMBER": "NI", "SORT_CODE": "SORT"}


def _luhn(text: str) -> bool:
    digits = [int(d) for d in re.sub(r"\D", "", text)]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _pieces(text: str, patterns: list[tuple[re.Pattern, str]], card: re.Pattern) -> tuple[list[tuple[str | None, int | None]], list[tuple[str, str]]]:
    """A message as literal pieces and numbers of values, and its values (kind, original) in the order in which patterns find them.

    A value leaves a mark as wide as its token, of characters that no pattern takes and the message lacks.
    """
    sign = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)
    digits = [c for c in map(chr, range(0xF0000, 0xF0100)) if c not in text][:11]
    found: list[tuple[str, str]] = []

    def mark(kind: str, original: str) -> str:
        found.append((kind, original))
        return sign + "".join(digits[int(d)] for d in str(len(found) - 1)).rjust(len(kind) + 7, digits[10])

    text = card.sub(lambda m: mark("CARD", m[0]) if _luhn(m[0]) else m[0], text)
    for pattern, kind in patterns:

        def put(m, kind=kind, text=text):
            near = text[max(0, m.start() - ACCOUNT_SPAN) : m.start()].lower()
            return mark("ACCT" if kind == "NUM" and any(w in near for w in ACCOUNT_WORDS) else kind, m[0])

        text = pattern.sub(put, text)
    number = {d: str(k) for k, d in enumerate(digits[:10])} | {digits[10]: ""}
    pieces: list[tuple[str | None, int | None]] = []
    for k, part in enumerate(re.split(f"{sign}([{''.join(digits)}]+)", text)):
        pieces.append((None, int("".join(map(number.__getitem__, part)))) if k % 2 else (part, None))
    return pieces, found


#: Values of seq numbered by one task at a time.
SEQ_BLOCK = 1024
#: Characters of messages that a task looks at before it gives away what they hold.
PARSE_CHARS = 1 << 18
_PARSED = "id long, session string, seq long, pieces array<struct<literal: string, at: int>>, found array<struct<kind: string, value: string>>"
_PIECES = pa.list_(pa.struct([("literal", pa.string()), ("at", pa.int32())]))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages (id, session, seq, text) as pieces and values (_PARSED), in batches of about PARSE_CHARS characters."""
    compiled, card = [(re.compile(p), _KINDS.get(n, n)) for p, n in PATTERNS], re.compile(CARD)
    for batch in batches:
        pieces, found, size = [], [], 0
        for k, value in enumerate(batch.column("text"), 1):
            text = value.as_py() or ""
            made = _pieces(text, compiled, card)
            pieces.append([{"literal": x, "at": at} for x, at in made[0]])
            found.append([{"kind": kind, "value": v} for kind, v in made[1]])
            size += len(text)
            if size >= PARSE_CHARS or k == batch.num_rows:
                done = batch.slice(k - len(pieces), len(pieces))
                arrays = [*(done.column(c) for c in ("id", "session", "seq")), pa.array(pieces, _PIECES), pa.array(found, _FOUND)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "session", "seq", "pieces", "found"])
                pieces, found, size = [], [], 0


def tokenize(messages: DataFrame) -> DataFrame:
    """Messages (session, seq, text) with personal data replaced by tokens that are stable in a session; ``tokens`` maps those of the message.

    Equal originals of a session share a token, whose kind is that of the first; numbers run by kind in the order of first occurrence: by
    ``seq``, then pattern, then place. Messages are looked at one by one; a session's distinct values are numbered in blocks of
    SEQ_BLOCK values of ``seq``, on from the counts of the blocks before, so no task holds a session. Null texts are empty.
    """

    bound_batches(messages.sparkSession)
    asked = messages.select(F.monotonically_increasing_id().alias("id"), F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "text")
    parsed = cut(asked.mapInArrow(_parse, _PARSED), "parsed-messages")
    each = parsed.select("id", "session", "seq", F.posexplode("found").alias("at", "f")).select("id", "session", "seq", "at", "f.kind", "f.value")
    first = each.groupBy("session", "value").agg(F.min(F.struct("seq", "id", "at", "kind")).alias("first")).select("session", "value", "first.*")
    block = first.withColumn("block", F.floor(F.coalesce("seq", F.lit(0)) / F.lit(SEQ_BLOCK)))
    before = Window.partitionBy("session", "kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = block.groupBy("session", "kind", "block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("session", "kind", "block").orderBy("seq", "id", "at"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("session", "kind", "block")]
    numbered = block.withColumn("_rank", rank).alias("b").join(starts.alias("s"), same[0] & same[1] & same[2])
    named = numbered.select(F.col("b.session").alias("_session"), F.col("b.value").alias("_value"), F.format_string("<<%s_%03d>>", F.col("b.kind"), F.col("s._start") + F.col("b._rank")).alias("token"))
    used = each.join(named, F.col("session").eqNullSafe(F.col("_session")) & (F.col("value") == F.col("_value")))
    held = used.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("at", "token", "value"))).alias("_t"))
    out = parsed.join(held, F.col("id") == F.col("_id"), "left")
    tokens = F.coalesce("_t", F.array().cast("array<struct<at:int,token:string,value:string>>"))
    text = F.array_join(F.transform("pieces", lambda p: F.coalesce(p["literal"], F.try_element_at(tokens, p["at"] + 1)["token"])), "")
    entries = F.map_from_entries(F.array_distinct(F.transform(tokens, lambda t: F.struct(t["token"].alias("key"), t["value"].alias("value")))))
    return out.select("session", "seq", text.alias("text"), entries.alias("tokens"))


def detokenize(text: str | Column, tokens: str | Column) -> Column:
    """Tokens back to their originals; tokens that the map lacks are dropped."""
    text, tokens = (F.col(c) if isinstance(c, str) else c for c in (text, tokens))
    known = F.aggregate(F.map_entries(tokens), text, lambda s, e: F.replace(s, e["key"], e["value"]))
    return F.regexp_replace(known, r"<<[A-Z]+_\d+>>", "")


def entities(texts: DataFrame, find) -> DataFrame:
    """Spans of named entities by a pluggable ``find(Series) -> Series of lists of (start, end, label)``; no model is shipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = find(batch["text"])
            yield pd.DataFrame([(i, s, e, label) for i, found in zip(batch["id"], spans, strict=True) for s, e, label in found], columns=["id", "start", "end", "label"])

    return texts.select("id", "text").mapInPandas(run, "id string, start int, end int, label string")
