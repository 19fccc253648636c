import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import packing
from tests.llm.conftest import same


def encoded(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(r[0], np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")) for r in rows]


def check(pieces, rows, window=1024):
    want = encoded(rows)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id in by_doc:
        copies = [ids for d, ids in want if d == doc_id]
        ids = copies[0]
        held = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in held) == len(ids) * len(copies)
        for p in held:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sorted(i for p in held for i in range(p.start, p.start + p.length)) == sorted(list(range(len(ids))) * len(copies))
    assert set(by_doc) == {r[0] for r in rows}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    short = 0
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    return short


def test_every_id_once(docs, rows):
    assert check(packing.piece_digests(packing.pack(docs)).collect(), rows) <= 1


def test_shards(docs, rows):
    pieces = packing.piece_digests(packing.pack(docs, shard_rows=8)).collect()
    assert check(pieces, rows) <= 8


def test_texts_like_special_tokens(spark):
    rows = [(1, "a <|endoftext|> b  c\n\n d\t<|endoftext|><|endoftext|x <|endoftext|>", "en", "s", 1), (2, "ünï 日本語 🎉  x", "en", "s", 1), (3, "x" * 5000, "en", "s", 1)]
    check(packing.piece_digests(packing.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))).collect(), rows)


def test_added_token_has_its_own_id(spark):
    ids = packing.load_encoder().encode("x<|endoftext|>", allowed_special="all")
    assert ids[-1] == 50256 == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("x<|endoftext|>", add_special_tokens=False).ids[-1]


def test_repeated_rows_are_split_over_shards(spark):
    """400 equal rows of null id, and as many of one id: no shard holds them all."""
    rows = [(None, "some words of one text " * 9), (7, "other words of one text " * 9)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, shard_rows=50).groupBy(F.shiftright("sequence_id", 34).alias("shard")).agg(F.sum("length").alias("n")).collect()
    one = sum(r.n for r in pieces) / len(rows)
    assert len(pieces) >= 12 and max(r.n for r in pieces) < 120 * one


def test_neighbours_share_a_window():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * t, 1000 * t + 60, 200) for t in range(1, 9)]
    rows = [rng.permutation(topics[i % 8]) for i in range(80)]
    known = packing.Statistics(80, 200.0, np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=packing.VOCABULARY).astype(float))
    index = packing.Index(rows, known)
    unused = np.ones(80, bool)
    unused[[0, 8]] = False
    found = list(index.neighbours(0, unused))
    assert {r % 8 for r in found} == {0} and 8 not in found
    windows = defaultdict(set)
    for sequence, _, row, _, _ in packing.fill_windows(rows, known):
        windows[sequence].add(row % 8)
    assert np.mean([len(w) for w in windows.values()]) < 2.5


def test_bm25_is_the_formula():
    rows = [np.array([5, 5, 7]), np.array([5, 9]), np.array([9, 9, 9, 11])]
    df = np.zeros(packing.VOCABULARY)
    df[[5, 7, 9, 11]] = [2, 1, 2, 1]
    index = packing.Index(rows, packing.Statistics(3, 3.0, df))
    idf = np.log(1 + (3 - 2 + 0.5) / 2.5)
    assert abs(index.scores(1)[0] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 3))) < 1e-3
    assert list(index.neighbours(0, np.array([False, True, True]))) == [1]


def test_all_terms_of_a_seed_are_scored():
    """The seed's 40 rarest ids stand in no other row; it shares only common ones. Ranks are those of brute force."""
    rng = np.random.default_rng(4)
    rows = [np.concatenate((np.arange(500, 540), np.arange(100, 160))), *(rng.integers(100 + 2 * i, 300, rng.integers(20, 200)) for i in range(60)), np.arange(9000, 9050)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=packing.VOCABULARY).astype(float)
    known = packing.Statistics(len(rows), float(np.mean([len(r) for r in rows])), df)
    got = list(packing.Index(rows, known).neighbours(0, np.arange(len(rows)) > 0))
    want = {}
    for i, r in enumerate(rows[1:], 1):
        norm = packing.K1 * (1 - packing.B + packing.B * len(r) / known.mean_length)
        tf = {t: int((r == t).sum()) for t in np.intersect1d(rows[0], r)}
        if tf:
            want[i] = sum(np.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * n * (packing.K1 + 1) / (n + norm) for t, n in tf.items())
    assert len(want) > 20 and set(got) == set(want)
    assert all(want[a] >= want[b] - 2e-3 for a, b in zip(got[:-1], got[1:], strict=True))


def test_tables(docs, crowded, empty):
    assert packing.piece_digests(packing.pack(empty)).count() == 0
    both = [packing.piece_digests(packing.pack(d)).select("doc_id", "start", "length", "ids_crc32") for d in (docs, crowded)]
    assert same(*both)
