import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import toxicity as tox


def corpus(spark, n=500):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(["river", "stone", "light", "window", "garden", "paper"]) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 300))]
        bad = i % 5 == 3
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "Vile!", "rotten"]) if i % 2 else "grub" + rng.choice(["er", "en", "ix", str(i)])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = tox.toxicity_report(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == 500
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(spark, 200)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, round(r.score, 9)) for r in tox.toxicity_report(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 111, 112, 113, 1000):
        text, first, size = tox.cut_windows(np.array([0, n]))
        assert {int(f) + k for f, s in zip(first, size, strict=True) for k in range(s)} == set(range(n))
        assert (size <= tox.WINDOW).all() and len(set(first.tolist())) == len(first)
        if len(first) > 1:
            assert (np.diff(first) == tox.STRIDE).all()
            assert (first[1:] < first[:-1] + size[:-1]).all()


def test_gradients():
    rng = np.random.default_rng(0)
    inputs = np.stack([rng.integers(0, 50, 40) for _ in tox.TABLES], axis=1).astype(np.int32)
    w = {k: v.astype(np.float64) for k, v in tox.start_weights([rng.normal(0, 1, n).astype(np.float32) for n in tox.TABLES]).items()}
    first, size, y, weight = np.array([0, 10, 20]), np.array([8, 10, 6]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, g = tox.gradients(w, inputs, first, size, y, weight)
    for k in ("o", "a", "uf", "ub", "xf", "xb", "cb"):
        at, e = tuple(0 for _ in w[k].shape), 1e-4
        keep = w[k][at]
        w[k][at] = keep + e
        up = tox.gradients(w, inputs, first, size, y, weight)[0]
        w[k][at] = keep - e
        down = tox.gradients(w, inputs, first, size, y, weight)[0]
        w[k][at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5


def test_scoring_is_the_training_network():
    rng = np.random.default_rng(4)
    inputs = np.stack([rng.integers(0, n, 300) for n in tox.TABLES], axis=1).astype(np.int32)
    w = tox.start_weights([rng.normal(0, 1, n).astype(np.float32) for n in tox.TABLES])
    text, first, size = tox.cut_windows(np.array([0, 10, 10, 300]))
    logits = tox.window_logits(w, inputs, first, size)
    for i in range(len(first)):
        loss, _ = tox.gradients(w, inputs, first[[i]], size[[i]], np.array([1.0]), np.array([1.0]))
        assert abs(loss - np.log1p(np.exp(-logits[i]))) < 1e-3


def test_tables(spark, docs, rows, crowded, empty, labels):
    assert tox.toxicity_report(empty, labels).count() == 0
    assert tox.toxicity_report(docs, labels.limit(0)).count() == len(rows)
    assert tox.toxicity_report(docs, labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))).count() == len(rows)
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in tox.toxicity_report(d, labels).collect()) for d in (docs, crowded))
    assert a == b
