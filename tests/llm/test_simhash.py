import random

import numpy as np
import pyarrow as pa
import xxhash

from tallyforge.llm import simhash
from tallyforge.llm import words as W
from tests.llm.conftest import same


def plain_print(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """(doc_id, fingerprint, component) of each row, all pairs compared; rows of one id are one document."""
    top = {d: d for d, _ in rows if d is not None}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    known = [(d, f) for d, f in rows if d is not None]
    for i, (d, f) in enumerate(known):
        for e, g in known[:i]:
            if (f ^ g).bit_count() <= 3:
                x, y = sorted((find(d), find(e)))
                top[y] = x
    return sorted(str((d, f"{f:016x}", None if d is None else find(d))) for d, f in rows)


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one  TWO", "ÄB ÄB äb", "a b c " * 50, *(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(100))]
    data, offsets = W.text_bytes(pa.array(texts))
    assert simhash.fingerprints(data, offsets).tolist() == [plain_print(t) for t in texts]


def test_fingerprints_in_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    test_fingerprints()


def test_the_code_covers():
    """Every half has one anchor within 1, and flips lists all within 2."""
    rng = np.random.default_rng(1)
    syndrome = lambda x: int(np.bitwise_xor.reduce([i for i in range(1, 32) if x >> (i - 1) & 1] or [0]))
    for x in [0, *rng.integers(0, 1 << 31, 50).tolist()]:
        reached = [x ^ f for f in simhash.flips()[syndrome(x)]]
        every = {x} | {x ^ 1 << i for i in range(31)} | {x ^ 1 << i ^ 1 << j for i in range(31) for j in range(31)}
        assert sorted(reached) == sorted(y for y in every if syndrome(y) == 0)
        assert (reached[0] ^ x).bit_count() <= 1


def crowd(rng, n, bits):
    """Fingerprints around a few centres, each with up to ``bits`` bits changed."""
    out = []
    for _ in range(n):
        x = [0, 0xFFFFFFFFFFFFFFFF, 0x123456789ABCDEF0][rng.randrange(3)]
        for _ in range(rng.randrange(bits + 1)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_links_and_blocks(spark, monkeypatch):
    """Any pair within 3 bits is joined, whatever the bits and however full the anchors are."""
    rng = random.Random(4)
    for bits, block in ((9, 2048), (12, 4)):
        rows = [(i, f) for i, f in enumerate(crowd(rng, 400, bits))] + [(5, 77), (5, 1 << 40), (None, 0), (None, 77), (900, 0)]
        monkeypatch.setattr(simhash, "sketch_documents", lambda docs, shingle: docs)
        prints = spark.createDataFrame([(d, int(np.uint64(f).view(np.int64))) for d, f in rows], "doc_id long, fp long")
        got = simhash.find_groups(prints, block=block)
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_groups(rows)


def test_texts(spark, rows):
    data = [(r[0], r[1]) for r in rows] + [(3000, rows[0][1] + " end"), (None, rows[0][1])]
    got = simhash.find_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_groups([(d, plain_print(t)) for d, t in data])


def test_sent_to_few_anchors(spark):
    prints = spark.range(1000).selectExpr("xxhash64(id) fp")
    sent = simhash.replicate(prints)
    assert sent.groupBy("fp").count().where("count > 32").isEmpty() and sent.count() < 32_001


def test_tables(docs, crowded, empty):
    assert simhash.find_groups(empty).count() == 0
    assert same(simhash.find_groups(docs), simhash.find_groups(crowded))


def test_what_is_sent_to_anchors_is_never_broadcast(spark, monkeypatch):
    """Spark takes the exploded rows for few; the join with their anchors' sizes deals them by shuffle all the same."""
    plans, real = {}, simhash.materialise

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(simhash, "materialise", kept)
    prints = real(spark.range(2000).selectExpr("xxhash64(id) fp"), "prints")
    simhash.link_fingerprints(prints)
    assert "SortMergeJoin" in plans["anchors"] and "BroadcastExchange" not in plans["anchors"]
