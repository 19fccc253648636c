"""What was live when a decision was made, and fingerprints that tell drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per decision (decision_id, cutoff, recorded): pages live at its time, earlier decisions, and drift.

    ``log`` has page_id, ts, type and, the same in all rows, fingerprint. The log is counted once per
    distinct time, cumulatively within each hour (of a number: each 3,600), then looked up as of each
    cutoff; what came before an hour is a running sum over hours, of which there are few.
    """
    whole = log.schema["ts"].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz")
    hour = F.floor(F.col("at") / 3600) if whole else F.date_trunc("hour", "at")
    events = log.groupBy(F.col("ts").alias("at")).agg(F.count(F.lit(1)).alias("_page"), F.sum((F.col("type") == "Decision").cast("int")).alias("_dec"))
    events = events.select("at", "_page", "_dec", F.lit(None).cast("string").alias("decision_id"), F.lit(None).cast("string").alias("recorded"), F.lit(0).alias("_ask"))
    asks = decisions.select(F.col("cutoff").alias("at"), F.lit(0).alias("_page"), F.lit(0).alias("_dec"), "decision_id", "recorded", F.lit(1).alias("_ask"))
    every = events.unionByName(asks).withColumn("_hour", hour)
    within = Window.partitionBy("_hour").orderBy("at")
    upto = within.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tie = Window.partitionBy("_hour", "at")
    found = every.select("*", F.sum("_page").over(upto).alias("_pages"), (F.sum("_dec").over(upto) - F.sum("_dec").over(tie)).alias("_decs"))
    hours = every.groupBy("_hour").agg(F.sum("_page").alias("_p"), F.sum("_dec").alias("_d"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier = hours.select(F.col("_hour").alias("_h"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_p", "_d")))
    now = log.agg(F.max("fingerprint").alias("_now"))
    out = found.where("_ask = 1").join(earlier, F.col("_hour").eqNullSafe(F.col("_h"))).join(F.broadcast(now))
    live, prior = (F.col("_pages") + F.col("_p0")).alias("live_pages"), (F.col("_decs") + F.col("_d0")).alias("prior_decisions")
    return out.select("decision_id", live, prior, ((F.col("recorded") != "") & (F.col("recorded") != F.col("_now"))).alias("drift"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): a digest of a set of rows, whatever their order: per-row hashes are summed, so nothing is gathered."""
    line = F.xxhash64(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(line.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")), 256).alias("digest"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def counts_digest(counts: DataFrame) -> DataFrame:
    """One digest of all counts, in order of the tables' names; equal counts give an equal digest."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_name", "n"))), lambda s: F.concat_ws("=", s["table_name"], s["n"].cast("string"))), "|")
    return counts.agg(F.sha2(lines, 256).alias("digest"))


def suite_summary(results: DataFrame) -> DataFrame:
    """(suite, total, passed) of results (suite, passed boolean)."""
    return results.groupBy("suite").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"))
