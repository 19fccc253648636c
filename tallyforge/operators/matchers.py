"""Assertions over evaluation results, as columns: each gives whether a row passes.

A result is a JSON text; a path such as ``a.b[0].c`` names a place in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a share within which numbers count as about equal, of one at least.
NEAR = 0.01
OPERATIONS = ("eq", "lt", "gt", "lte", "gte", "approx")


def _place(path: str) -> str:
    """``a.b[0].c`` or ``a.b.0.c`` as a JSON path."""
    steps = [s for s in path.replace("[", ".").replace("]", "").split(".") if s]
    return "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in steps)


def resolve(result: Column, path: str) -> Column:
    """The text of what stands at the path, whose steps into lists may be ``[0]`` or ``.0``; null where there is nothing."""
    return F.get_json_object(result, _place(path))


def section_present(body: Column, section: str) -> Column:
    return F.coalesce(F.contains(body, F.lit(f"## {section}")), F.lit(False))


def contains_substring(result: Column, path: str, part: str) -> Column:
    return F.coalesce(F.contains(resolve(result, path), F.lit(part)), F.lit(False))


def regex_match(result: Column, path: str, pattern: str) -> Column:
    """Whether the pattern is found in the value, or in any element of a list, one a line."""
    value = resolve(result, path)
    lines = F.coalesce(F.array_join(F.from_json(value, "array<string>"), "\n"), value)
    return F.coalesce(F.when(F.startswith(value, F.lit("[")), lines).otherwise(value).rlike(pattern), F.lit(False))


def citation_count_gte(citations: Column, n: int) -> Column:
    return F.coalesce(F.size(citations), F.lit(0)) >= n


def numeric_field(result: Column, path: str, op: str, value: float) -> Column:
    """A number compared; what is no number fails."""
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op}")
    found = resolve(result, path).try_cast("double")
    ways = {"eq": found == value, "lt": found < value, "gt": found > value, "lte": found <= value, "gte": found >= value, "approx": F.abs(found - value) <= NEAR * max(abs(value), 1.0)}
    return F.coalesce(ways[op], F.lit(False))


def field_equals(result: Column, path: str, value: str) -> Column:
    return F.coalesce(resolve(result, path) == value, F.lit(False))


def list_length(result: Column, path: str, n: int) -> Column:
    """Whether a list has ``n`` elements, an object as many keys, or a text as many characters; other values have no length."""
    value = resolve(result, path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(result), _place(path), "variant"))
    size = F.when(kind.startswith("ARRAY"), F.json_array_length(value)).when(kind.startswith("OBJECT"), F.size(F.json_object_keys(value))).when(kind == "STRING", F.length(value))
    return F.coalesce(size == n, F.lit(False))


def returns_row(query: DataFrame, expected: list) -> bool:
    """Whether a query's first row is the expected one."""
    first = query.limit(1).collect()
    return bool(first) and list(first[0]) == expected


def assertions(results: DataFrame, suite: Column, checks: dict[str, Column]) -> DataFrame:
    """(suite, check_name, passed) of every row and check, ready for replay.suite_summary."""
    each = [results.select(suite.alias("suite"), F.lit(name).alias("check_name"), passed.alias("passed")) for name, passed in checks.items()]
    return reduce(DataFrame.unionByName, each)
