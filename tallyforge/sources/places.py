"""Folders for tables that a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch on its way to a Python worker; a larger row travels alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, so that texts passed through Python don't fill executors."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/tallyforge-scratch"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to a scratch folder and read back, so that a long lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
