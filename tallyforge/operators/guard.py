"""Read-only SQL for outside callers, and checks of what they claim."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY

#: Words that no read-only query may hold.
WRITE_WORDS = ["DETACH", "DELETE", "CREATE", "MERGE", "SET", "REMOVE", "DROP", "APOC.REFACTOR", "APOC.CREATE", "APOC.MERGE", "APOC.PERIODIC.COMMIT", "INSERT", "UPDATE", "TRUNCATE", "COPY", "ALTER", "GRANT", "REVOKE"]
_WRITES = re.compile(r"\b(" + "|".join(map(re.escape, WRITE_WORDS)) + r")\b", re.IGNORECASE)
_QUOTED = re.compile(r"'[^']*'?")
ROW_LIMIT = 1000
TIMEOUT_S = 5.0


class QueryRejected(ValueError):
    """The query isn't a single read-only one."""


def reject_writes(query: str) -> None:
    """Raise if a write word stands outside single quotes."""
    bare = _QUOTED.sub(lambda m: " " * len(m[0]), query)
    if found := _WRITES.search(bare):
        raise QueryRejected(f"{found[0]!r} is not allowed in a read-only query")


def reject_several(query: str) -> str:
    """The query without its closing semicolon; raise at another statement, or at one that doesn't begin with SELECT or WITH."""
    bare = _QUOTED.sub(lambda m: "x" * len(m[0]), query).rstrip()
    if bare.endswith(";"):
        bare = bare[:-1].rstrip()
    if ";" in bare:
        raise QueryRejected("one statement only")
    if not re.match(r"\s*(SELECT|WITH)\b", bare, re.IGNORECASE):
        raise QueryRejected("only SELECT and WITH are allowed")
    return query[: len(bare)]


@dataclass
class Answer:
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False
    error: str | None = None


def query(spark: SparkSession, sql: str, args: dict | None = None, limit: int = ROW_LIMIT) -> DataFrame:
    """The query's rows, one more than ``limit`` at most. Parameters are bound, never pasted."""
    reject_writes(sql)
    return spark.sql(reject_several(sql), args=args or {}).limit(limit + 1)


def execute(spark: SparkSession, sql: str, args: dict | None = None, limit: int = ROW_LIMIT, timeout_s: float = TIMEOUT_S, max_bytes: int | None = None) -> Answer:
    """Run a guarded query; whatever goes wrong comes back as ``error``.

    Beyond ``timeout_s`` its jobs are cancelled. An expensive plan is refused before it runs (``refuse_expensive``), and with ``max_bytes`` one
    whose result is estimated to be larger.
    """
    tag = f"guard-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelAllJobs())
    try:
        df = query(spark, sql, args, limit)
        refuse_expensive(df)
        if max_bytes is not None and estimated_bytes(df) > max_bytes:
            return Answer(error="the plan is too expensive")
        timer.start()
        rows = [r.asDict() for r in df.collect()]
        return Answer(df.columns, rows[:limit], len(rows) > limit)
    except Exception as e:  # errors are values here
        return Answer(error=f"{type(e).__name__}: {e}".split("\n")[0])
    finally:
        timer.cancel()
        spark.removeTag(tag)


@dataclass
class PlanNode:
    """A node of the optimised plan: its name, Spark's estimate of what it gives, and why it is expensive if it is."""

    name: str
    depth: int
    bytes: int
    rows: int | None
    problem: str | None = None


#: Estimated bytes: of both sides of a join without a condition, of a scan that no filter narrows, and of all that a plan sorts, joins or groups.
CARTESIAN_BYTES, SCAN_BYTES, MOVED_BYTES = 10 << 20, 1 << 40, 1 << 42
MOVING = {"Join", "Aggregate", "Sort", "Window", "Distinct", "RepartitionByExpression", "Repartition"}


def plan_nodes(df: DataFrame, cartesian_bytes: int = CARTESIAN_BYTES, scan_bytes: int = SCAN_BYTES, moved_bytes: int = MOVED_BYTES) -> list[PlanNode]:
    """The nodes of the optimised plan from the top, each with its statistics; nothing is run.

    A problem is a join without a condition whose sides may both have several rows and are large together, a relation that is
    read whole although it is large, and the node at which the bytes that joins, groupings and sorts take exceed ``moved_bytes``.
    Statistics are Spark's; those of ``ANALYZE TABLE`` with ``spark.sql.cbo.enabled`` make them better.
    """
    out: list[PlanNode] = []
    moved = 0

    def walk(node, depth: int, filtered: bool) -> None:
        nonlocal moved
        kind, stats = node.getClass().getSimpleName(), node.stats()
        size, rows = int(str(stats.sizeInBytes())), stats.rowCount()
        children = [node.children().apply(i) for i in range(node.children().size())]
        one = PlanNode(kind, depth, size, int(str(rows.get())) if rows.isDefined() else None)
        out.append(one)
        sizes = [int(str(c.stats().sizeInBytes())) for c in children]
        if kind == "Join" and node.condition().isEmpty() and node.joinType().toString() in ("Inner", "Cross", "FullOuter", "LeftOuter", "RightOuter"):
            many = [not (c.maxRows().isDefined() and int(str(c.maxRows().get())) <= 1) for c in children]
            if all(many) and sum(sizes) > cartesian_bytes:
                one.problem = f"a join of all pairs of {sizes[0]} and {sizes[1]} bytes"
        if kind == "LogicalRelation" and not filtered and size > scan_bytes:
            one.problem = f"a scan of {size} bytes without a filter"
        if kind in MOVING:
            moved += sum(sizes)
            if moved > moved_bytes and one.problem is None:
                one.problem = f"{moved} bytes are sorted, joined or grouped up to here"
        for c in children:
            walk(c, depth + 1, kind == "Filter" or filtered and kind in ("Project", "SubqueryAlias"))

    walk(df._jdf.queryExecution().optimizedPlan(), 0, False)
    return out


def refuse_expensive(df: DataFrame, **limits: int) -> None:
    """Raise QueryRejected with the first problem of the plan (``plan_nodes``)."""
    for node in plan_nodes(df, **limits):
        if node.problem:
            raise QueryRejected(f"the plan is too expensive: {node.problem}")


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def explain(spark: SparkSession, sql: str, args: dict | None = None) -> dict:
    """The plan, Spark's estimate of its size, and each node with its statistics; the query is not run."""
    reject_writes(sql)
    df = spark.sql(reject_several(sql), args=args or {})
    return {"plan": df._jdf.queryExecution().toString(), "estimated_bytes": estimated_bytes(df), "nodes": plan_nodes(df)}


def reconcile(transactions: DataFrame, first: date, until: date, claimed: str, tolerance: str = "0.01", **equal) -> DataFrame:
    """(actual, n, claimed, gap, matches) of the signed sum from ``first`` to before ``until``, with any column fixed by keyword."""
    rows = transactions.where((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(until)))
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    out = rows.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("actual"), F.count(F.lit(1)).alias("n"))
    claim = F.lit(claimed).cast("decimal(18,4)")
    gap = (F.col("actual").cast("decimal(18,4)") - claim).cast("decimal(18,4)")
    return out.select("actual", "n", claim.alias("claimed"), gap.alias("gap"), (F.abs(gap) <= F.lit(tolerance).cast("decimal(18,4)")).alias("matches"))


#: Who may do what. A scope of ``system`` lets anyone.
ACTION_SCOPES = {
    "upsert_account": ["system"],
    "upsert_statement": ["system"],
    "upsert_merchant": ["system", "statement_ingester"],
    "upsert_subscription": ["system", "statement_ingester"],
    "upsert_goal": ["system", "user"],
    "upsert_budget": ["system", "user"],
    "record_net_worth": ["system", "monthly_analyst"],
    "merge_merchant_aliases": ["user", "statement_ingester"],
    "publish_memo": ["monthly_analyst"],
    "publish_recommendation": ["advisor"],
}


def invoke(action: str, actor: str, do, *inputs, scopes: dict[str, list[str]] | None = None):
    """``do(*inputs)`` if the actor may; KeyError for an unknown action, PermissionError for a wrong actor."""
    table = ACTION_SCOPES if scopes is None else scopes
    if action not in table:
        raise KeyError(action)
    if "system" not in table[action] and actor not in table[action]:
        raise PermissionError(f"{actor} may not {action}")
    return do(*inputs)
