"""Entity resolution: BM25 over names, cosine over vectors, and their blend by ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
K1, B = 1.2, 0.75
#: Buckets of a stored index's terms.
BUCKETS = 64


def tokens(c):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def full_text(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(id, score) of the k best by BM25 over ``name`` and ``aliases``; ties by id. A blank query finds nothing."""
    terms = entities.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term"))
    words = entities.select("id", tokens(F.concat_ws(" ", "name", F.array_join("aliases", " "))).alias("_t"))
    size = words.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_t")).alias("_mean"))
    postings = words.select("id", F.size("_t").alias("_len"), F.explode("_t").alias("term")).join(terms, "term").groupBy("id", "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    both = postings.join(df, "term").join(F.broadcast(size))
    idf = F.log1p((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    return both.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def build_index(entities: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store BM25's postings (term, id, tf, len, df) of entities (id, name, aliases) by hash of the term, and the corpus's size.

    Built once; ``search_index`` then reads only the buckets of a query's terms, and in them, being sorted, little beside those terms.
    A bucket with a common term is written by several tasks.
    """
    words = entities.select("id", tokens(F.concat_ws(" ", "name", F.array_join("aliases", " "))).alias("_t"))
    postings = words.select("id", F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stored = postings.join(df, "term").withColumn("bucket", _bucket(F.col("term"), buckets))
    stored.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/size")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def search_index(spark: SparkSession, path: str, query: str, k: int = 10) -> DataFrame:
    """(id, score) as ``full_text`` gives it, from a stored index. Only the query's terms come to the driver."""
    size = spark.read.parquet(f"{path}/size").first()
    asked = [] if not size["n"] else spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("t")).select("t", _bucket(F.col("t"), size["buckets"]).alias("b")).collect()
    if not asked:
        return spark.createDataFrame([], "id string, score double")
    held = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({r["b"] for r in asked})) & F.col("term").isin(sorted(r["t"] for r in asked)))
    n, mean = F.lit(size["n"]), F.lit(size["mean"])
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return held.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def vector(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(id, score) of the k largest dot products (cosines of unit vectors); ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def blend(lists: list[DataFrame], k: int = 5) -> DataFrame:
    """Reciprocal rank fusion: the sum over lists of 1 / (60 + position), positions from 0."""
    ranked = [x.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("_pos")) for x in lists]
    score = F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("_pos"))), 6).alias("score")
    return reduce(DataFrame.unionByName, ranked).groupBy("id").agg(score).orderBy(F.desc("score"), "id").limit(k)


def resolve(entities: DataFrame, query: str, embedding: list[float] | None = None, vectors: DataFrame | None = None, k: int = 5, index: str | None = None) -> DataFrame:
    """The k likeliest entities; without vectors by text alone, for a blank query none. With ``index`` text is looked up in one that is stored."""
    if not query.strip():
        return entities.select("id", F.lit(0.0).alias("score")).limit(0)
    pool = max(3 * k, 10)
    lists = [search_index(entities.sparkSession, index, query, pool) if index else full_text(entities, query, pool)]
    if embedding is not None and vectors is not None:
        lists.append(vector(vectors, embedding, pool))
    return blend(lists, k)


def lookup(merchants: DataFrame, q: str | None = None, category_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Merchants whose name contains ``q`` in either case, in a category; each condition is optional."""
    out = merchants
    if q:
        out = out.where(F.lower("canonical_name").contains(q.lower()))
    if category_id is not None:
        out = out.where(F.col("category_id") == category_id)
    out = out.orderBy("canonical_name", "id")
    return out.limit(limit) if limit else out
