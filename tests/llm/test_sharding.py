import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import sharding
from tests.llm.conftest import same


def test_law_and_slots(docs, rows):
    got = sharding.shard_documents(docs).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key"
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def placed(spark, tree, n=4000):
    return {r.k: r.s for r in sharding.descend(spark.range(n).withColumnRenamed("id", "k"), "k", tree, "s").collect()}


def test_shares_follow_weights(spark):
    tree = sharding.even_tree(8)
    even = Counter(placed(spark, tree, 16000).values())
    assert set(even) == set(range(8)) and max(even.values()) < 1.15 * min(even.values())
    tree["region0"]["rack0"][0] = 4.0
    assert 0.33 < Counter(placed(spark, tree, 16000).values())[0] / 16000 < 0.4


def test_movement_stays_in_the_changed_path(spark):
    tree = sharding.even_tree(8)
    before = placed(spark, tree)
    tree["region0"]["rack0"][0] = 2.0
    after = placed(spark, tree)
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved
    assert all(b // 4 == 0 for _, b in moved)
    assert all(not (a // 2 == 1 and b // 2 == 1) and not (a // 4 == 1 and b // 4 == 1) for a, b in moved)
    tree["region0"]["rack0"][0] = 0.0
    gone = placed(spark, tree)
    assert 0 not in gone.values()


def test_tables(spark, docs, crowded, empty):
    assert sharding.shard_documents(empty).count() == 0
    assert same(sharding.shard_documents(docs).drop("slot"), sharding.shard_documents(crowded).drop("slot"))
    nulls = spark.range(5).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert sorted(r.slot for r in sharding.shard_documents(nulls).collect()) == list(range(5))


def test_any_number_of_shards_grows_into_the_new_one(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for n in (1, 3, 5, 6, 7):
        got = sharding.shard_documents(d, n).collect()
        assert all(r.shard < n and r.grown_shard in (r.shard, n) for r in got)
        assert {r.grown_shard for r in got} == set(range(n + 1))


def test_columns_of_any_name_stay(docs):
    from pyspark.sql import functions as F

    names = ["_bucket", "_rank", "_shard", "_at", "_start", "_s_region", "_s_rack"]
    frame = docs.select("doc_id", *(F.lit("x").alias(n) for n in names))
    out = sharding.number_slots(sharding.descend(frame, "doc_id", sharding.even_tree(8), "s"), "s", ["doc_id"], ["doc_id"])
    assert out.columns == ["doc_id", *names, "s", "slot"] and out.where("_bucket = 'x' and _start = 'x' and _s_region = 'x'").count() == docs.count()
