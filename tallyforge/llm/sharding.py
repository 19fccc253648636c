"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.shared import free_name

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Hash buckets by which the rows of one shard are numbered; each is numbered by itself.
SLOT_BUCKETS = 1024


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Shards 0 to ``shards - 1`` of weight 1, filling racks and regions in order."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grown_tree(shards: int) -> dict[str, dict[str, dict[int, float]]]:
    """``even_tree(shards)`` and one more shard, in a new rack of a new region."""
    tree = even_tree(shards)
    racks = sum(len(r) for r in tree.values())
    return tree | {f"region{len(tree)}": {f"rack{racks}": {shards: 1.0}}}


def _draw(key: Column, choices: Mapping[str, float]) -> Column:
    """The choice with the largest ln(u) / weight; u is a hash of the key and the choice alone.

    A choice is taken with a chance in proportion to its weight. When one weight grows,
    rows only move to that choice; when it shrinks, rows only leave it.
    """
    live = {name: weight for name, weight in choices.items() if weight > 0}
    if not live:
        raise ValueError("a level of the tree has no choice of positive weight")
    if len(live) == 1:
        return F.lit(next(iter(live)))
    scored = []
    for name, weight in sorted(live.items()):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(1)).cast("double") / F.lit(float(1 << 53))
        scored.append(F.struct((F.log(u) / F.lit(float(weight))).alias("score"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scored))["name"]


def _cases(on: Column, arms: Mapping[str, Column]) -> Column:
    out = None
    for name, arm in arms.items():
        out = F.when(on == name, arm) if out is None else out.when(on == name, arm)
    return out


def descend(df: DataFrame, key: str, tree: Tree, into: str) -> DataFrame:
    """Add column ``into`` (int): the shard reached from the root by draws at each level.

    A region's weight is the sum of its racks', a rack's that of its shards. A change
    inside one rack alters only the weights on its path: rows enter or leave that
    subtree, and rows of the other subtrees that stay keep their shard.
    Null keys hash as one value, equal keys reach one shard, extra columns of any name pass through; a column
    ``into`` of before is replaced.
    """
    weights = {region: {rack: float(sum(leaves.values())) for rack, leaves in racks.items()} for region, racks in tree.items()}
    region, rack = free_name(df, f"_{into}_region"), free_name(df, f"_{into}_rack")
    out = df.withColumn(region, _draw(F.col(key), {r: sum(w.values()) for r, w in weights.items()}))
    out = out.withColumn(rack, _cases(F.col(region), {r: _draw(F.col(key), w) for r, w in weights.items() if sum(w.values()) > 0}))
    leaves = {name: _draw(F.col(key), {f"shard{s}": w for s, w in shards.items()}) for racks in tree.values() for name, shards in racks.items() if sum(shards.values()) > 0}
    return out.withColumn(into, F.substring(_cases(F.col(rack), leaves), 6, 9).cast("int")).drop(region, rack)


def number_slots(df: DataFrame, shard: str, keys: list[str], order: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add ``slot`` (long): gapless from 0 in each shard; a column ``slot`` of before is replaced, others of any name pass through.

    Rows are numbered within (shard, hash bucket of the keys); a bucket starts where the
    buckets before it end. The starts are at most shards x ``buckets`` rows, which bounds
    their broadcast. No shard is gathered in one task.
    """
    bucket, rank, of, at, start = (free_name(df, n) for n in ("_bucket", "_rank", "_shard", "_at", "_start"))
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit("slot"), *keys), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(F.col(shard).alias(of), F.col(bucket).alias(at)).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(of, at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(shard, bucket).orderBy(*order)
    numbered = cut.withColumn(rank, F.row_number().over(within) - F.lit(1))
    joined = numbered.join(F.broadcast(starts), (F.col(shard) == F.col(of)) & (F.col(bucket) == F.col(at)))
    return joined.withColumn("slot", F.col(start) + F.col(rank)).drop(bucket, rank, of, at, start)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: shard, slot and the shard it would have with one more.

    Law ``key``: the document id and the tree of ``shards`` decide. The extra shard is put into a
    region of its own, whatever ``shards`` is, so rows only move into it. Null texts
    have size 1; null ids share one shard; repeated rows get one shard and different slots.
    """
    sized = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = descend(sized, "doc_id", even_tree(shards), "shard")
    placed = descend(placed, "doc_id", grown_tree(shards), "grown_shard")
    return number_slots(placed, "shard", ["doc_id", "text_crc32"], ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
