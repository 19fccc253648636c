import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta,", "Gamma", "délta", "e", "the", "zeta.\nOn"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, null, empty and blank texts, one long text, a repeated row and a null source."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.replace("alpha", "omega", 3)
    texts = [base, near, base, None, "", " \t\n ", "one", "one", "Two words", words(rng, 30000), base.upper()] + [words(rng, rng.randrange(20, 200)) for _ in range(30)]
    out = [(i, t, "en", None if i == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[12]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same rows beside columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "size", "copy", "shuffle_key", "rate", "spans", "ids", "start", "length", "sequence_id", "offset", "pid", "key", "n", "c", "kind", "graph", "group", "component", "kept", "bucket", "part", "held_out", "score", "declared", "content", "parts", "kept_at", "n_words", "anomaly"]
    return docs.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 4 != 0), int(r[0] % 5 == 1)) for r in rows[:-1]], "doc_id long, quality int, toxic int")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
