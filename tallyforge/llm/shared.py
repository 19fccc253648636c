"""Tables cut from their lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.places import bound_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; then a folder of this machine is
    used. On a cluster an unset folder is an error, since executors share no local disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and "cluster" not in master:
        return f"file://{tempfile.gettempdir()}/tallyforge-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that come sorted by integer ``keys``, cut only where a group of equal keys ends."""
    held: list[pa.RecordBatch] = []
    last: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
        other = np.flatnonzero((at != at[:, -1:]).any(axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and not cut and last == at[:, 0].tolist():
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held, last = [batch.slice(cut)], at[:, -1].tolist()
    if held:
        yield pa.Table.from_batches(held)
