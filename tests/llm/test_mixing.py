import hashlib
import math

from pyspark.sql import functions as F

from tallyforge.llm import mixing
from tests.llm.conftest import same


def plain_count(doc_id, rate):
    u = int(hashlib.md5(f"mix-1|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    p = total = math.exp(-rate)
    k = 0
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts(docs, rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + 1
    whole = sum(math.sqrt(n) for n in sizes.values())
    rate = {s: math.sqrt(n) / whole * len(rows) / n for s, n in sizes.items()}
    got = {r.doc_id: r.n for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in rows:
        times = rows.count(r)
        assert got.get(r[0], 0) == times * plain_count(r[0], rate[r[3]])


def test_weights_are_met(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15000, "big").when(F.col("id") < 19900, "mid").otherwise("small").alias("source"), F.lit("t").alias("text"))
    got = {r.source: r.n / 20000 for r in mixing.mix_sources(d, {"big": 1, "mid": 1, "small": 2}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 0.25) < 0.02 and abs(got["mid"] - 0.25) < 0.02 and abs(got["small"] - 0.5) < 0.03
    assert {r.source for r in mixing.mix_sources(d, {"mid": 3.0}).select("source").distinct().collect()} == {"mid"}


def test_large_and_small_rates(spark):
    one = spark.range(1)
    for rate in (0.001, 1.0, 40.0, 2000.0):
        steps = one.select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
        assert abs(steps[-1] - 1) < 1e-6
        assert steps == sorted(steps)
    assert one.select(mixing.poisson_steps(F.lit(0.0)).alias("s")).first().s == [1.0]


def test_order_and_tables(spark, docs, crowded, empty, monkeypatch):
    mixed = mixing.mix_sources(docs)
    keys = [r.shuffle_key for r in mixed.where("copy >= 0").collect()]
    assert len(keys) > 10
    assert mixing.mix_sources(empty).count() == 0
    assert same(mixed.select("doc_id", "copy", "shuffle_key"), mixing.mix_sources(crowded).select("doc_id", "copy", "shuffle_key"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert same(mixed, mixing.mix_sources(docs))
    assert not same(mixed.select("doc_id", "copy"), mixing.mix_sources(docs, seed="other").select("doc_id", "copy"))


def test_sql_gives_the_same_rows(spark):
    import duckdb

    from tallyforge.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(queries.ORACLES["op2_source_mixing"])
    names = [c[0] for c in found.description]
    df = queries.op2_source_mixing(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())


def plain_sum(doc_id, rate):
    parts = max(1, math.ceil(rate / 32))
    total = 0
    for j in range(parts):
        word = f"mix-1|{doc_id}" + (f"|{j}" if j else "")
        u, p, k = int(hashlib.md5(word.encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate / parts), 0
        below = p
        while below <= u:
            k += 1
            p *= rate / parts / k
            below += p
        total += k
    return total


def test_large_rates_are_sums_of_draws(spark):
    import time

    d = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"))
    got = {r.doc_id: r.n for r in d.select("doc_id", mixing.poisson_draw(F.lit(500.0), "mix-1", F.col("doc_id")).alias("n")).collect()}
    assert got == {i: plain_sum(i, 500.0) for i in range(40)}
    assert abs(sum(got.values()) / 40 - 500) < 15
    began = time.time()
    one = spark.range(1).select(mixing.poisson_draw(F.lit(40_000.0), "mix-1", F.lit(1)).alias("n")).first().n
    assert abs(one - 40_000) < 1_200 and time.time() - began < 10


def test_columns_of_any_name_stay(spark):
    d = spark.createDataFrame([(1, "s", "t", 5, 6, 7, 8), (2, "s", "t", 5, 6, 7, 8)], "doc_id long, source string, text string, _source int, _steps int, _n int, _parts int")
    got = mixing.mix_sources(d, {"s": 1.0})
    assert got.columns == [*d.columns, "copy", "shuffle_key"]
    assert {(r._source, r._steps, r._n, r._parts) for r in mixing.mix_sources(d.unionAll(d).unionAll(d)).collect()} <= {(5, 6, 7, 8)}
