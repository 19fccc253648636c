"""Where results go: pages, audit logs, graphs and reports."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.sources import pages


def audit_rows(actions: DataFrame) -> DataFrame:
    """Audit lines of governed actions (ts, action, actor, inputs, result) with their decision ids."""
    return actions.select(F.col("ts"), text.decision_id(F.col("ts"), F.col("action"), F.col("actor")).alias("decision_id"), "action", "actor", "inputs", "result")


def append_audit(actions: DataFrame, path: str) -> None:
    audit_rows(actions).write.mode("append").json(path)


def prompt_rows(prompts: DataFrame, mask: Column) -> DataFrame:
    """Prompts as they may be kept: masked, with a hash of the original."""
    return prompts.select("ts", mask.alias("redacted"), F.sha2("prompt", 256).alias("sha256"))


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fingerprint(**tables: DataFrame) -> DataFrame:
    """(name, n, digest): rows of each table and the sum of their hashes, which no order of rows changes."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))
    return reduce(DataFrame.unionByName, [one(name, df) for name, df in sorted(tables.items())])


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, force: bool = False) -> bool:
    """Write both tables unless they are those written last; says whether it wrote.

    The fingerprint is taken over all values, so an edit that leaves the counts as they are
    is seen. It is written last: after a failed run the graph is written again.
    """
    now = sorted(map(tuple, fingerprint(vertices=vertices, edges=edges).collect()))
    before = read_or_none(vertices.sparkSession, f"{path}/fingerprint")
    if not force and before is not None and sorted(map(tuple, before.select("name", "n", "digest").collect())) == now:
        return False
    vertices.sparkSession.createDataFrame([], "name string, n long, digest string").write.mode("overwrite").parquet(f"{path}/fingerprint")
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    vertices.sparkSession.createDataFrame(now, "name string, n long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fingerprint")
    return True


def keep_rules(rules: DataFrame, path: str, version: int | None = None) -> None:
    """Append rules (surface, merchant_id, category_id) to those kept; of a surface's the one of the highest version holds.

    Without a ``version`` the clock gives one, which only suits a single writer.
    """
    rules.select("surface", "merchant_id", "category_id", F.lit(time.time_ns() if version is None else version).alias("kept_at")).write.mode("append").parquet(path)


def kept_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule of each surface, none where nothing has been kept."""
    rows = read_or_none(spark, path)
    if rows is None:
        return spark.createDataFrame([], "surface string, merchant_id string, category_id int")
    newest = rows.groupBy("surface").agg(F.max(F.struct("kept_at", "merchant_id", "category_id")).alias("r"))
    return newest.select("surface", "r.merchant_id", "r.category_id")


def compact_rules(spark: SparkSession, path: str, into: str) -> None:
    """Write the rules that hold, each with its version, to a new folder, which then takes rules as the old one did."""
    rows = read_or_none(spark, path)
    if rows is not None:
        newest = rows.groupBy("surface").agg(F.max(F.struct("kept_at", "merchant_id", "category_id")).alias("r"))
        newest.select("surface", "r.merchant_id", "r.category_id", "r.kept_at").write.parquet(into)


def report_page(summary: DataFrame) -> DataFrame:
    """(name, content): one Markdown table of the suites' (suite, total, passed), and what all of them passed."""
    line = F.format_string("| %s | %d/%d |", "suite", "passed", "total")
    held = summary.agg(F.sort_array(F.collect_list(F.struct("suite", line.alias("line")))).alias("rows"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return held.select(F.lit("report.md").alias("name"), F.concat(F.format_string("# Evaluation\n\n%d of %d passed.\n\n| Suite | Passed |\n|---|---|\n", "passed", "total"), body).alias("content"))


def write_report(summary: DataFrame, path: str) -> None:
    """A summary of suites as JSON lines and as a page."""
    summary.write.mode("overwrite").json(f"{path}/json")
    pages.write(report_page(summary), f"{path}/page")


def replace_table(df: DataFrame, path: str) -> str:
    """Write the next version of a table beside the others; the newest folder is the table."""
    at = f"{path}/v{time.time_ns()}"
    df.write.parquet(at)
    return at
